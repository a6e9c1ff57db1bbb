"""Vector search: exact, filtered, quantised, rescored; corpus measures.

The queries are a stated set, taken in blocks of a bounded number; the corpus is dealt over the cluster's cores, every row is scored against a block in
place (`nearest.py`), and each task sends only its best k per query to the shuffle: ids and scores, no vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.shared import discard, saved
from . import nearest

# Python workers get the code itself: the package need not be installed beside them
cloudpickle.register_pickle_by_value(nearest)

MAX_QUERIES = 10_000


def prepared(df: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v, norm, scale, codes, code_norm, sign: what scoring needs, computed once per row."""
    one = df.select(F.col(id_).alias("id"), F.col(vector).alias("v")).withColumn("norm", V.norm(F.col("v"))).withColumn("scale", V.int8_scale(F.col("v")))
    return one.withColumn("codes", V.int8_codes(F.col("v"), F.col("scale"))).withColumn("code_norm", V.norm(F.col("codes"))).withColumn("sign", V.sign_code(F.col("v")))


def scored(corpus: DataFrame, queries: DataFrame, score: Callable[[], Column], own: bool = False) -> DataFrame:
    """Every corpus row with every query and its score; own: a query meets its own row too.  Queries are taken in blocks of at most MAX_QUERIES, by
    a hash of their id, so that what is broadcast has a bound whatever their number."""
    named = queries.select([F.col(c).alias(f"q_{c}") for c in queries.columns])
    n = -(-queries.count() // MAX_QUERIES) or 1
    parts = [corpus.crossJoin(F.broadcast(named if n == 1 else named.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == b))) for b in range(n)]
    every = reduce(DataFrame.unionByName, parts)
    return (every if own else every.where("id <> q_id")).withColumn("score", score())


def top_k(corpus: DataFrame, queries: DataFrame, score: Callable[[], Column], k: int, descending: bool = True, same_ids: bool = False) -> DataFrame:
    """q_id, id, score, rank: the best k per query, ties by id.  A stated query set against all rows; same_ids: the queries are numbered on their own, so
    that an equal id means nothing.  A score that is not one of this module's is any expression over a row and a query, evaluated for each pair."""
    if (score, descending) in ((exact, True), (by_int8, True), (by_sign, False)):
        told = best(corpus, queries, score, k, own=same_ids).select("q_id", "id", "score")
    else:
        told = scored(corpus, queries, score, own=same_ids).select("q_id", "id", "score")
    return _ranked(told, F.col("score").desc() if descending else F.col("score").asc_nulls_last(), k)


def _ranked(told: DataFrame, order: Column, k: int) -> DataFrame:
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(order, "id"))).where(F.col("rank") <= k)


def best(corpus: DataFrame, queries: DataFrame, score: Callable[[], Column], k: int, own: bool = False, gap: float | None = None) -> DataFrame:
    """q_id, id, score, cosine: at least the best k per query by exact, by_int8 or by_sign, from every part of the corpus its best k.  gap: rows as near as
    that are left out.  Where the corpus has a column `list` and the queries have `lists`, a row meets the queries of its list.  The number of parts is the
    cluster's, so what is sent on grows with the number of queries alone.  Only a block of queries is on the driver at once."""
    vector = F.col("codes" if score is by_int8 else "v").alias("v")
    spark = corpus.sparkSession
    rows = corpus.select(F.col("id").cast("long").alias("id"), vector, *[c for c in corpus.columns if c == "list"])
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, 2), "id")
    asked = queries.select(F.col("id").cast("long").alias("id"), vector, *[c for c in queries.columns if c == "lists"])
    n = -(-queries.count() // MAX_QUERIES) or 1
    if n > 1:
        # one look at the table for all blocks
        rows, asked = saved(rows, "corpus"), saved(asked, "queries")
    parts = []
    for b in range(n):
        block = asked if n == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        found = rows.sortWithinPartitions("id").mapInArrow(nearest.searcher(block.toArrow(), k, score is by_sign, own, gap), "q_id long, id long, score double, cosine double")
        parts.append(found if n == 1 else saved(found, "nearest"))
    if n > 1:
        discard(rows)
        discard(asked)
    return reduce(DataFrame.unionByName, parts)


def exact() -> Column:
    return V.cosine(F.col("v"), F.col("q_v"), F.col("norm"), F.col("q_norm"))


def by_int8() -> Column:
    """Cosine of the codes as they are stored: each vector's scale cancels out, so nothing is decoded."""
    return V.cosine(F.col("codes"), F.col("q_codes"), F.col("code_norm"), F.col("q_code_norm"))


def by_sign() -> Column:
    return V.hamming(F.col("sign"), F.col("q_sign")).cast("double")


def rescored(corpus: DataFrame, queries: DataFrame, k: int, widen: int) -> DataFrame:
    """k * widen candidates by Hamming distance, then the best k of them by cosine."""
    wide = _ranked(best(corpus, queries, by_sign, k * widen), F.col("score").asc_nulls_last(), k * widen)
    return _ranked(wide.select("q_id", "id", F.col("cosine").alias("score")), F.desc("score"), k)


#: lists of an inverted index, at most: their centres travel with every task
MAX_LISTS = 4096


def centres(corpus: DataFrame, lists: int) -> DataFrame:
    """centres: one row with an array of (id, v, norm): the vectors that the least hashes of their ids pick, a bounded sample.  Every row is indexed."""
    picked = corpus.orderBy(F.md5(F.col("id").cast("string")), "id").limit(min(lists, MAX_LISTS)).select("id", "v", "norm")
    return picked.agg(F.collect_list(F.struct("id", "v", "norm")).alias("centres"))


def near_lists(rows: DataFrame, index: DataFrame, probes: int) -> DataFrame:
    """rows with lists: the ids of the nearest centres, ties to the least id.  The centres are one broadcast row; nothing is shuffled."""
    scored_ = F.transform("centres", lambda c: F.struct((-V.cosine(F.col("v"), c["v"], F.col("norm"), c["norm"])).alias("far"), c["id"].alias("id")))
    return rows.crossJoin(F.broadcast(index)).withColumn("lists", F.transform(F.slice(F.array_sort(scored_), 1, probes), lambda s: s["id"])).drop("centres")


def probes_for(corpus: DataFrame, queries: DataFrame, k: int, lists: int, target: float) -> int:
    """How many lists have to be probed for a share of the true neighbours of some queries (a stated, bounded set, searched exactly).  Vectors
    without clusters need most of them, and then an index saves little."""
    index = centres(corpus, lists)
    truth = top_k(corpus, queries, exact, k).select("q_id", "id")
    home = near_lists(corpus, index, 1).select("id", F.col("lists")[0].alias("list"))
    asked = near_lists(queries, index, lists).select(F.col("id").alias("q_id"), F.posexplode("lists").alias("place", "list"))
    # a histogram of at most `lists` rows
    places = truth.join(home, "id").join(F.broadcast(asked), ["q_id", "list"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    total, upto = sum(r["n"] for r in places), 0
    for r in places:
        upto += r["n"]
        if upto >= target * total:
            return r["place"] + 1
    return lists


def approximate(corpus: DataFrame, queries: DataFrame, k: int, lists: int = 16, probes: int = 6) -> DataFrame:
    """q_id, id, score, rank: the best k among the rows whose list is one of the query's nearest.  Every row is in exactly one list."""
    index = centres(corpus, lists)
    placed = near_lists(corpus, index, 1).withColumn("list", F.col("lists")[0]).drop("lists")
    return _ranked(best(placed, near_lists(queries, index, probes), exact, k).select("q_id", "id", "score"), F.desc("score"), k)


def mean_scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """q_id, total, n: the sum of a query's cosines with all rows, its own included, and their number.  A sum of cosines is one product with the sum of the rows
    scaled to length 1, so no pair is made."""
    sums = corpus.select("v").mapInArrow(nearest.unit_sums, "dim int, n long, v array<double>").groupBy("dim").applyInArrow(nearest.merged, "dim int, n long, v array<double>")
    met = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("norm").alias("q_norm")).join(F.broadcast(sums), (F.size("q_v") == F.col("dim")) & ~F.exists("q_v", lambda x: x.isNull()))
    return met.select("q_id", (V.dot(F.col("q_v"), F.col("v")) / F.when(F.col("q_norm") == 0, 1.0).otherwise(F.col("q_norm"))).alias("total"), "n")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """recall: hits over all wanted."""
    hits = found.select("q_id", "id").join(truth.select("q_id", "id"), ["q_id", "id"], "left_semi").agg(F.count("*").alias("hits"))
    n = truth.agg(F.count_distinct("q_id").alias("nq"))
    return hits.crossJoin(n).select("hits", (F.col("hits") / (F.col("nq") * k)).alias("recall"))


def gram_moments(sample: DataFrame) -> DataFrame:
    """trace and the squared Frobenius norm of the sample's Gram matrix.  Both are sums over the d x d moment matrix, which partial aggregation
    builds without any pair of rows: sum over i, j of (v_i . v_j)^2 equals the squared norm of sum of v_i v_i^T."""
    moved = sample.select(F.posexplode("v").alias("a", "x"), "v").select("a", "x", F.posexplode("v").alias("b", "y"))
    matrix = moved.groupBy("a", "b").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("m"))
    return matrix.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("m"))).alias("trace"), F.sum(F.col("m") * F.col("m")).alias("fro"))
