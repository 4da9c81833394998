"""Registered queries beside their SQL counterparts. ``python check.py`` runs all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import _rows

QUICK = [
    "page_scan", "result_preview", "store_snapshot", "store_get", "template_apply", "log_windows", "nav_links", "node_tag_counts", "css_union", "css_then_xpath",
    "visible_text", "dom_context", "main_content_text", "element_xpath", "extract_records", "response_json", "plan_key_fields", "parse_selectors", "fill_template",
    "build_prompts", "token_usage", "coerce_url", "coerce_date", "list_emptied", "quality_report", "recover_selectors", "batch_extract", "run_diff", "table_extract",
    "selectors_by_table", "batch_issues", "recover_from_responses", "recover_reextract", "prompt_dedup", "dom_extract_uncapped", "extract_metadata", "multi_page_plan",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    assert got.num_rows > 0 and _rows(got, cols) == _rows(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_counterpart():
    from gleanery.checks import ORACLES, QUERIES

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_no_cross_joins(spark, sf):
    for name in ("css_select_scoped", "extract_records", "selector_match_count", "table_extract", "recover_selectors", "failed_fields"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
