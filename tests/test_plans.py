"""The plans are the ones that are wanted: what reaches the scan, what is pruned before a shuffle."""

import re

import pytest

from keelspark.plans import registry

QUERIES = registry.queries()


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().toString()


def scans(text):
    return re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", text)


@pytest.mark.parametrize("name, column, pushed", [("count_status", "o_orderstatus", "EqualTo(o_orderstatus,P)"), ("count_expensive", "o_totalprice", "GreaterThan(o_totalprice,400000.0)")])
def test_filters_and_columns_reach_the_scan(spark, sf, name, column, pushed):
    (cols, filters), *_ = scans(plan(spark, sf, name))
    assert re.sub(r"#\d+L?", "", cols) == column and pushed in filters


def test_only_needed_columns_are_read(spark, sf):
    for name, most in (("hybrid_index_doc", 4), ("ts_rollup_avg_1h", 3), ("distinct_exact", 2), ("bitmap_tag_counts", 3)):
        assert all(len(cols.split(",")) <= most for cols, _ in scans(plan(spark, sf, name))), name


@pytest.mark.parametrize("name", ["retain_last_n", "vector_topk_exact", "vector_rerank"])
def test_top_k_is_pruned_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(spark, sf, name)


@pytest.mark.parametrize("name", ["upsert_latest", "namespace_profile", "shard_counts", "bloom_fp_rate", "layout_run_state"])
def test_aggregates_are_partial_first(spark, sf, name):
    assert re.search(r"partial_\w+\(", plan(spark, sf, name))


def test_no_cartesian_product(spark, sf):
    for name in QUERIES:
        if not name.startswith("stream_"):
            assert "CartesianProduct" not in plan(spark, sf, name), name
