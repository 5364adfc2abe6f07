"""Registered queries against DuckDB over the same tables, and checks of the plans."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# Queries that take longer because they run the whole audit, linking, mapping or file readers once more; another query of the
# same operator runs always. With TEST_ALL_QUERIES they run too.
LONG = {"a02_audit_scores", "u01_a11_issue_rollup", "a11_health", "s21_wide_mapping", "a17_issue_summary", "a08_site_scores", "a07_mapping_stats",
        "a04_best_linked_subcategories", "a04_largest_categories", "a04_small_categories", "a04_link_summary", "a04_best_linked_categories", "j12_r05_apply_choices",
        "r06_simple_matches", "j13_manual_overrides", "s04_category_files", "a10_collapsed_issues", "l01_link_rules_hold", "l02_s20_wide_links",
        "s14_nested_json_files", "s02_xml_product_files", "s13_nested_xml_files"}
NAMES = sorted(k for k in ORACLES if os.environ.get("TEST_ALL_QUERIES") or k not in LONG and not k.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    order = [names.index(x) for x in cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert sorted(tuple(plain(r[x]) for x in cols) for r in df.collect()) == want


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    total = [r for r in rows if r["family"] is None][0]
    assert total["issues"] == total["errors"] + total["warnings"] > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["j04_j05_category_counts", "g01_g07_category_feed", "l01_link_products", "a10_collapsed_issues", "s13_s14_taxonomy_tree", "c01_c09_content", "j01_orphan_variants", "w05_j14_status_changes",
                                  "j11_x16_link_checks", "w01_stock_order", "a05_tree_counts"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_few_columns(spark):
    plan = QUERIES["a12_stock_bands"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in [f for line in plan.splitlines() if "documents.parquet" in line for f in line.split("ReadSchema")[-1].split("<")[-1].split(",")]
    assert "ReadSchema: struct<doc_id:bigint>" in plan
