"""Searches by matrix products: the rows and ties of the column expressions, on odd vectors too, and no row for a pair."""

import math

import duckdb
import numpy as np
import pytest
from compare import duck_rows, spark_rows

from keelspark.operators import vectors as search
from keelspark.plans import registry

SEARCHES = {"exact": (search.exact, True), "int8": (search.by_int8, True), "sign": (search.by_sign, False)}


def odd(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(60, 8)).astype(np.float32)]
    vectors += vectors[:20] * 3 + [[0.0] * 8] * 5 + [[2 * x for x in v] for v in vectors[:10]]
    vectors += [None, [None] + [1.0] * 7, [1.0, 2.0], [], [float("nan")] + [1.0] * 7, [1e38] * 8, [1e-40] * 8, None]
    vectors += [[float(x) for x in v] for v in rng.integers(-1, 2, size=(40, 8))]
    order = rng.permutation(len(vectors))
    return spark.createDataFrame([(int(i), vectors[j]) for i, j in enumerate(order)], "vec_id long, embedding array<float>")


def told(df):
    clean = lambda x: "nan" if x is not None and math.isnan(x) else x
    return sorted((r.q_id, r["rank"], r.id, clean(r.score)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 200])
@pytest.mark.parametrize("name", SEARCHES)
def test_rows_and_ties_are_those_of_the_expressions(spark, name, k):
    score, descending = SEARCHES[name]
    df = search.prepared(odd(spark))
    if name == "int8":
        df = df.where("not exists(v, x -> isnan(x))")
    # a search by any other callback scores each pair by an expression
    assert told(search.top_k(df, df, score, k, descending)) == told(search.top_k(df, df, lambda: score(), k, descending))


def test_small_tiles_and_blocks_give_the_same(spark, monkeypatch):
    df = search.prepared(odd(spark))
    whole = [told(search.top_k(df, df, *SEARCHES[n][:1], 7, SEARCHES[n][1])) for n in SEARCHES]
    monkeypatch.setattr(search, "MAX_QUERIES", 40)
    monkeypatch.setattr(search.nearest, "TILE_QUERIES", 3)
    monkeypatch.setattr(search.nearest, "TILE_ROWS", 5)
    assert [told(search.top_k(df, df, *SEARCHES[n][:1], 7, SEARCHES[n][1])) for n in SEARCHES] == whole


def test_copies_made_for_blocks_are_deleted(spark, monkeypatch):
    from pathlib import Path

    from keelspark.sources.shared import shared_root

    monkeypatch.setattr(search, "MAX_QUERIES", 40)
    df = search.prepared(odd(spark))
    assert search.top_k(df, df, search.exact, 3).count()
    folder = Path(shared_root(spark).removeprefix("file://")) / "keelspark"
    assert list(folder.glob("nearest-*")) and not list(folder.glob("corpus-*")) and not list(folder.glob("queries-*"))


def test_sign_codes_beyond_64_dimensions(spark):
    rows = [(i, [1.0 if (i >> (j % 5)) & 1 and j > 63 else -1.0 for j in range(70)]) for i in range(32)]
    df = search.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    v = np.array([r[1] for r in rows]) > 0
    for q, rank, i, score in told(search.top_k(df, df, search.by_sign, 31, False)):
        assert score == (v[q] != v[i]).sum() and rank >= 1


@pytest.fixture(scope="module")
def copies(tmp_path_factory, sf):
    """The vectors four times over, so that near copies and ties abound."""
    at = tmp_path_factory.mktemp("copies")
    duckdb.sql(f"copy (select vec_id + 500 * i as vec_id, list_transform(embedding, lambda x: CASE WHEN i = 3 THEN CAST(x * 2 AS FLOAT) ELSE x END) as embedding, label from '{sf}/embeddings.parquet', range(4) r(i)) to '{at}/embeddings.parquet'")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    return str(at), con


def pairless(spark, copies, name):
    """The query gives what its SQL gives on copies, and no plan of it makes a row of a pair of vectors."""
    at, con = copies
    df = registry.queries()[name](spark, at)
    text = df._jdf.queryExecution().toString()
    assert "MapInArrow" in text and "q_sign" not in text
    assert spark_rows(df) == duck_rows(con.sql(registry.oracle_sql()[name]))


def test_recall_ann(spark, copies):
    pairless(spark, copies, "recall_ann")


def test_vector_rerank(spark, copies):
    pairless(spark, copies, "vector_rerank")


def test_recall_int8(spark, copies):
    pairless(spark, copies, "recall_int8")


def test_corpus_similarity(spark, copies):
    pairless(spark, copies, "corpus_similarity")


def test_vector_ann(spark, copies):
    pairless(spark, copies, "vector_ann")


def test_semantic_cache_lookup(spark, copies):
    pairless(spark, copies, "semantic_cache_lookup")


def test_relative_contrast(spark, copies):
    pairless(spark, copies, "relative_contrast")


def test_recall_binary(spark, copies):
    pairless(spark, copies, "recall_binary")


def test_vector_topk_exact(spark, copies):
    pairless(spark, copies, "vector_topk_exact")
