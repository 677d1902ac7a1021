"""Physical plans stay the ones that hold at scale."""

import re

from siftline import queries as engine
from siftline.operators import extraction, validation
from siftline.sources import pages

SF = "/root/testdata/sf0.01"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_and_validation_do_not_shuffle(spark):
    parsed = pages.parse_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    checked = validation.validate(extraction.extract(parsed, engine.PAGE_PLAN), engine.PAGE_PLAN)
    assert "Exchange" not in plan(checked)


def test_rules_on_tables_stay_in_the_jvm(spark):
    text = plan(engine.QUERIES["record_status"](spark, SF))
    assert not re.search("Exchange|Python|Arrow", text)


def test_top_k_is_not_a_sort(spark):
    for name in ("outbox_due_topk", "frontier_first"):
        assert "TakeOrderedAndProject" in plan(engine.QUERIES[name](spark, SF)), name


def test_filters_and_columns_reach_the_scan(spark):
    text = engine.QUERIES["ownership_chain"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThan(l_shipdate" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert any(s.startswith("l_orderkey") and s.count(":") == 3 for s in schemas)
    due = engine.QUERIES["outbox_due_topk"](spark, SF)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(ts" in due and "value" not in "".join(re.findall(r"ReadSchema: struct<([^>]*)", due))


def test_latest_is_one_shuffle(spark):
    assert plan(engine.QUERIES["latest_completed"](spark, SF)).count("Exchange hashpartitioning") == 1
    assert plan(engine.QUERIES["state_current"](spark, SF)).count("Exchange hashpartitioning") == 1


def test_text_functions_stay_native(spark):
    for name in ("norm_email", "relevance_score", "url_canonical", "url_policy", "csv_guard", "identity_hash", "anchors"):
        assert not re.search("Exchange|Python|Arrow", plan(engine.QUERIES[name](spark, SF))), name
