"""Mixing against a plain computation, and positions against the integral of the schedules."""

import re
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm.mixing import demand_position, in_training_order, mix_plan


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; sources at their limit stop, the excess is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    fixed, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return {**fixed, **share}
        for s in above:
            fixed[s] = float(most * sizes[s])
            left -= fixed[s]


def brute(rows, block=0):
    """(doc_id, size, source, target, copies) of (doc_id, text, source)."""
    items = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = {s: sum(x[1] for x in items if x[2] == s) for s in {x[2] for x in items}}
    aim, out = targets(sizes), []
    for s in sizes:
        mine = sorted((x for x in items if x[2] == s), key=lambda x: (md5(f"0:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
        rounds, start = int(aim[s] // sizes[s]) if sizes[s] else 0, 0
        for i, n, _ in mine:
            more = start + n / 2 < aim[s] - rounds * sizes[s]
            out.append((i, n, s, aim[s], rounds + more if sizes[s] else 0))
            start += n
    return out


def got(plan):
    return [(r["doc_id"], r["mix"]["size"], r["source"], r["mix"]["target"], r["mix"]["copies"]) for r in plan.collect()]


@pytest.mark.parametrize("block", [50_000, 7])
def test_fixture(docs, rows, block):
    plan = mix_plan(docs, block_rows=block)
    have, want = sorted(got(plan)), sorted(brute([(r["doc_id"], r["text"], r["source"]) for r in rows]))
    assert [(h[0], h[1], h[2], h[4]) for h in have] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert [h[3] for h in have] == pytest.approx([w[3] for w in want])
    assert sorted(got(plan)) == have  # reruns agree
    for s in {h[2] for h in have}:
        taken, target = sum(h[1] * h[4] for h in have if h[2] == s), next(h[3] for h in have if h[2] == s)
        assert abs(taken - target) <= max(h[1] for h in have if h[2] == s) / 2 + 1
    assert max(h[4] for h in have) <= 3


def test_odd_rows_and_empty_table(odd, empty):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    key = lambda x: str(x)
    assert sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in got(mix_plan(odd))), key=key) == sorted(
        ((a, b, c, round(d, 6), e) for a, b, c, d, e in brute(rows)), key=key)
    assert in_training_order(mix_plan(odd)).columns == odd.columns
    assert mix_plan(empty).collect() == [] and in_training_order(mix_plan(empty)).collect() == []


def test_training_order(docs):
    plan = mix_plan(docs)
    copies = in_training_order(plan, "at").collect()
    assert [r["at"] for r in copies] == sorted(r["at"] for r in copies)
    assert all(0 <= r["at"] <= 1 for r in copies)
    assert len(copies) == plan.agg(F.sum("mix.copies")).first()[0]


@pytest.mark.parametrize("schedule", [(1.5, 1.0, 0.5), (1, 1, 1), (0.5, 1.0, 1.5), (0, 2), (2, 0), (1, 0, 0, 3), (0, 0, 1)])
def test_position_inverts_the_integral(spark, schedule):
    shares = [i / 40 for i in range(41)]
    t = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "s double").select(demand_position(F.col("s"), schedule)).collect()]
    grid = np.linspace(0, 1, 20001)
    weight = np.interp(grid, np.linspace(0, 1, len(schedule)), schedule)
    area = np.concatenate(([0], np.cumsum((weight[1:] + weight[:-1]) / 2)))
    assert np.interp(t, grid, area / area[-1]) == pytest.approx(shares, abs=1e-4)
    assert t == sorted(t)


def test_bad_schedules(spark):
    for schedule in [(1,), (0, 0), (1, -1)]:
        with pytest.raises(ValueError):
            demand_position(F.lit(0.5), schedule)
