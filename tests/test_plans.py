"""Plans keep to joins on keys, stay in the JVM and read only the columns they need."""

from __future__ import annotations

import re

import pytest

from codecorpus.plans.all_queries import queries

SF = "/root/testdata/sf0.001"
WITH_PYTHON = {"inference_responses", "scanned_files", "files_read_whole", "refused_overwrites"}
NAMES = sorted(queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in WITH_PYTHON:
        assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups", plan)


def test_scan_reads_only_the_needed_columns(spark):
    plan = plan_of(queries()["line_counts"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "lang:string" not in plan


def test_confidence_filter_reaches_the_scan_side_of_the_shuffle(spark):
    plan = plan_of(queries()["confident_suggestions"](spark, SF))
    assert plan.index("Exchange") < plan.index("Filter")


def test_expiry_filter_is_pushed_into_a_stored_cache(spark, tmp_path):
    from codecorpus.operators import cache as op
    from codecorpus.plans import relations as rel

    path = str(tmp_path / "cache")
    rel.cache_entries(spark, SF).write.parquet(path)
    plan = plan_of(op.drop_expired(spark.read.parquet(path), rel.now()))
    assert "PushedFilters: [IsNotNull(expires_at), GreaterThanOrEqual(expires_at" in plan


def test_statistics_and_chunks_need_no_shuffle(spark):
    for name in ("unit_statistics", "obfuscation_indicators", "overlap_chunks", "unit_identifiers",
                 "step_chain", "parsed_suggestions", "token_limits", "request_cost"):
        plan = plan_of(queries()[name](spark, SF)).replace("BroadcastExchange", "")
        assert "Exchange" not in plan, name


def test_best_suggestion_is_combined_before_its_only_shuffle(spark):
    plan = plan_of(queries()["best_suggestion"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_max" in plan and "Window" not in plan


def test_renames_move_a_text_once(spark):
    """Distinct names and their renames are shuffled apart from the text."""
    for name in ("rename_applied", "rename_everywhere", "rename_hits"):
        plan = plan_of(queries()[name](spark, SF))
        moves = re.findall(r"(?:Exchange|ReusedExchange)[^\n]*REPARTITION_BY_NUM[^\n]*", plan)
        assert len(moves) == 2  # the same part is reused when it runs


def test_eviction_filters_in_place(spark):
    plan = plan_of(queries()["cache_after_eviction"](spark, SF))
    assert plan.count("Scan") < 10 and "Window" not in plan and "Subquery" not in plan
