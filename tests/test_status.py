import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stocklens.streaming import status as st

SCHEMA = "poll_id long, ts timestamp, platform string, status string, status_text string, indicator string"


def polls(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + timedelta(hours=h), p, s, f"t{i}", "x") for i, h, p, s in rows], SCHEMA)


ROWS = [(1, 0, "a", "operational"), (2, 1, "a", "major_outage"), (3, 30, "a", "major_outage"), (4, 31, "a", "degraded"),
        (5, 80, "a", "partial_outage"), (6, 0, "b", "major_outage"), (7, 90, "b", "unknown")]


def test_changes_across_days(spark):
    got = {r["poll_id"]: r for r in st.status_changes(polls(spark, ROWS)).collect()}
    assert [got[i]["previous"] for i in range(1, 8)] == [None, "operational", "major_outage", "major_outage", "degraded", None, "major_outage"]
    assert {i for i, r in got.items() if r["alert"]} == {2, 5, 6}
    assert not got[3]["changed"] and got[6]["changed"]


def test_state_and_view(spark):
    state = st.next_state(st.status_changes(polls(spark, ROWS)))
    platforms = spark.createDataFrame([("a",), ("b",), ("c",)], "platform string")
    got = {r["platform"]: r for r in st.current_view(platforms, state).collect()}
    assert got["a"]["status"] == "partial_outage" and got["a"]["status_text"] == "t5"
    assert got["c"]["status"] == "unknown" and got["c"]["status_text"] == "Not yet checked" and got["c"]["last_checked"] is None


def test_stream_in_several_batches_equals_batch(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [[r for r in ROWS if r[1] < 1], [r for r in ROWS if 1 <= r[1] < 40], [r for r in ROWS if r[1] >= 40], [(8, 5, "a", "major_outage")]]
    for cut in cuts:
        polls(spark, cut).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        st.monitor(stream, folder, interval=None).awaitTermination()
    alerts = {r["poll_id"] for r in st.read_alerts(spark, folder).collect()}
    assert alerts == {2, 5, 6}  # the late poll 8 is older than the last check and is ignored
    want = {r["platform"]: (r["status"], r["last_checked"], r["last_changed"]) for r in st.next_state(st.status_changes(polls(spark, ROWS))).collect()}
    assert {r["platform"]: (r["status"], r["last_checked"], r["last_changed"]) for r in st.read_state(spark, folder).collect()} == want


def test_state_is_kept_once_per_platform_and_batches_are_not_counted_twice(spark, tmp_path):
    """Restarts without new polls change nothing; a late poll and one at the time of the last check are ignored."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    polls(spark, ROWS).write.parquet(source)
    run = lambda: st.monitor(spark.readStream.schema(SCHEMA).parquet(source), folder, interval=None).awaitTermination()
    run()
    alerts, state = st.read_alerts(spark, folder).collect(), st.read_state(spark, folder).collect()
    run()
    polls(spark, [(9, 80, "a", "operational"), (10, 3, "b", "operational")]).write.mode("append").parquet(source)
    run()
    assert sorted(st.read_alerts(spark, folder).collect()) == sorted(alerts)
    assert sorted(st.read_state(spark, folder).collect()) == sorted(state) and len(state) == 2
    polls(spark, [(11, 81, "a", "operational"), (12, 82, "a", "major_outage"), (13, 83, "c", "unknown")]).write.mode("append").parquet(source)
    run()
    assert {r["poll_id"] for r in st.read_alerts(spark, folder).collect()} == {r["poll_id"] for r in alerts} | {12}
    assert {r["platform"]: r["status"] for r in st.read_state(spark, folder).collect()} == {"a": "major_outage", "b": "unknown", "c": "unknown"}


def test_a_missing_state_stops_the_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), tmp_path / "out"
    polls(spark, ROWS).write.parquet(source)
    run = lambda: st.monitor(spark.readStream.schema(SCHEMA).parquet(source), str(folder), interval=None).awaitTermination()
    run()
    (folder / "progress" / "state").rename(folder / "progress" / "gone")
    polls(spark, [(20, 200, "a", "operational")]).write.mode("append").parquet(source)
    with pytest.raises(Exception):
        run()


def line(poll_id, hour, platform, kind, body):
    return json.dumps({"poll_id": poll_id, "fetched_at": f"2024-01-01T{hour:02d}:00:00Z", "platform": platform, "kind": kind, "body": body})


def test_poll_log_in_two_batches(spark, tmp_path):
    """Failed and unreadable answers are rows; files are read once, oldest first."""
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    outage, fine = '{"status":{"indicator":"critical","description":"Down"}}', '{"status":{"indicator":"none"}}'
    first = [line(1, 0, "a", "json", fine), line(2, 1, "a", "json", None), line(3, 2, "a", "json", outage), "no json",
             line(4, 0, "b", "feed", "<description>X is Operational</description>")]
    second = [line(5, 3, "a", "json", "<html>"), line(6, 4, "b", "feed", "<description>X Major Outage</description>"), line(7, 5, "a", "json", outage)]
    for k, lines in enumerate((first, second)):
        (source / f"{k}.txt").write_text("\n".join(lines))
        os.utime(source / f"{k}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
    parsed = {r["poll_id"]: (r["status"], r["status_text"]) for r in st.parse_poll_lines(spark.read.text(str(source))).collect()}
    assert parsed[2] == ("unknown", "Unable to fetch status") == parsed[5] and len(parsed) == 7
    assert parsed[6] == ("major_outage", "Major Outage (1 services)")
    query = st.monitor(st.poll_stream(spark, str(source), files_per_batch=1), folder, interval=None)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    assert {r["poll_id"]: r["previous"] for r in st.read_alerts(spark, folder).collect()} == {3: "unknown", 6: "operational", 7: "unknown"}


def test_feeds(spark):
    feed = lambda *x: "<rss><description>Status page</description>" + "".join(f"<description>S {d}</description>" for d in x)
    cases = [(feed("is Operational", "Major Outage", "Partial outage"), "major_outage", "Major Outage (1 services)"),
             (feed("is degraded", "under maintenance"), "degraded", "Degraded (2 services)"), (feed("is operational"), "operational", "All Systems Operational"),
             ("", "unknown", "Unable to determine status"), (None, "unknown", "Unable to determine status")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "x string").select(st.parse_feed_poll(F.col("x")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [c[1:] for c in cases]


def test_json(spark):
    cases = ['{"status":{"indicator":"minor","description":"Slow"}}', "x", '{"status":{"indicator":"odd","description":"?"}}']
    rows = spark.createDataFrame([(c,) for c in cases], "x string").select(st.parse_json_poll(F.col("x")).alias("r")).select("r.status").collect()
    assert [r[0] for r in rows] == ["degraded", "unknown", "unknown"]


def test_poll_log_grows_by_bounded_parts(spark, tmp_path, monkeypatch):
    """Ten parts give the alerts of two, and no micro-batch reads more polls than a part has."""
    from stocklens.plans import feed_queries as fq

    kinds = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "signup", "error")]), (F.col("id") * 7919 % 4 + 1).cast("int"))
    spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"),
                            (F.col("id") * 31 % 17).alias("user_id"), kinds.alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    two = sorted(fq.QUERIES["t03_poll_log"](spark, str(tmp_path)).collect())
    sizes, read = [], fq.st.monitor

    def counted(polls, folder, **how):
        query = read(polls, folder, **how)
        query.awaitTermination()
        sizes.extend(p.numInputRows for p in query.recentProgress)
        return query

    monkeypatch.setattr(fq, "POLLS_AT_ONCE", 100)
    monkeypatch.setattr(fq.st, "monitor", counted)
    assert sorted(fq.QUERIES["t03_poll_log"](spark, str(tmp_path)).collect()) == two and len(two) > 50
    assert len([n for n in sizes if n]) == 4 and max(sizes) < 150 and sum(sizes) == 400
