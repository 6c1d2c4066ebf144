"""What the plans must and must not contain, with automatic broadcasts switched off."""

import re

import pytest

from foliospark.plans.queries import QUERIES

STREAMS = {"cascade_rewrite", "delivered_documents", "kept_orders_by_status", "kept_recent_orders", "manuscript_files", "orders_stream", "pending_work_stream", "live_uploads_stream", "staged_stream", "status_stream", "two_pass_inference"}
PYTHON = {"docx_bulk_extract"}
LENGTHS = {"windowed_reviews", "structure_losses"}  # only arrays of lengths go to Python
TEXT_FREE = ("pending_languages", "request_blockers", "original_lookup", "delivery_resolve", "delivery_manifest", "results_by_order")


@pytest.fixture(scope="module")
def plan(spark, small):
    made = {}

    def make(name):
        if name not in made:
            before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            try:
                made[name] = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        return made[name]

    return make


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_slow_paths(plan, name):
    text = plan(name)
    for bad in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "Scan ExistingRDD"):
        assert bad not in text, bad
    assert ("ArrowEvalPython" in text) == (name in LENGTHS)
    assert "SinglePartition" not in text
    assert ("InPandas" in text) == (name in PYTHON)


@pytest.mark.parametrize("name", ["quote_orders", "voucher_apply", "shown_vs_charged", "word_counts", "mark_spans", "structure_check",
                                  "strategy_contract", "strategy_render", "retention_due", "recent_orders", "tier_assign_range_join"])
def test_no_shuffle(plan, name):
    assert "Exchange hashpartitioning" not in plan(name)


def test_dimensions_are_broadcast_and_nothing_else_is(plan):
    assert plan("quote_orders").count("BroadcastHashJoin") == 2
    for name in ("delivery_resolve", "orphan_files", "promote_originals", "request_blockers", "order_progress"):
        assert "Broadcast" not in plan(name)


@pytest.mark.parametrize("name", ["status_transitions", "illegal_transitions"])
def test_windows_never_span_a_key(plan, name):
    """The log itself is windowed by key and range; by key alone only the summary of the ranges is."""
    text = plan(name)
    assert "Broadcast" not in text
    by_key = [line for line in text.splitlines() if "Window" in line and re.search(r"\], \[_key#\d+\]", line)]
    assert by_key and all("_last" in line for line in by_key)


@pytest.mark.parametrize("name", TEXT_FREE)
def test_text_is_not_read(plan, name):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(name)):
        assert "text:" not in schema


def test_json_is_parsed_once(plan):
    assert plan("editorial_json_parse").count("from_json") == 2  # check, then read
    assert plan("payment_events_to_orders").count("from_json") == 6


def test_pushed_filters(plan):
    assert re.search(r"PushedFilters: \[[^\]]*event_type", plan("order_status_latest"))


@pytest.mark.parametrize("name", ["payment_events_to_orders", "order_status_latest", "staged_upsert", "delivery_resolve", "orphan_files"])
def test_hot_keys_are_combined_before_the_shuffle(plan, name):
    assert "partial_" in plan(name)
