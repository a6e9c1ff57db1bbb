"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import vectors as V
from ..operators import vectors as O
from ..sources.tables import table
from .registry import query

_COS = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))))"
_TOP = f"SELECT q_id, id, score, rank FROM (SELECT b.vec_id AS q_id, a.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id {{more}}) WHERE rank <= 10"
# the same search over int8 and sign codes
_CODED = """coded AS (SELECT vec_id, embedding, CASE WHEN m = 0 THEN 1e-9 ELSE m / 127 END AS scale FROM (SELECT *, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)),
e8 AS (SELECT vec_id, embedding, scale, list_transform(embedding, lambda x: CAST(least(127, greatest(-127, floor(CAST(x AS DOUBLE) / scale + 0.5))) AS INTEGER)) AS codes FROM coded)"""
_E1 = "e1 AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"
_HAM = "list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))"


def _sets(spark, d):
    """All rows, and every row whose id is divisible by 50 as a query against all others."""
    rows = O.prepared(table(spark, d, "embeddings"))
    return rows, rows.where("id % 50 = 0")


def _shown(df):
    return df.select("q_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_cosine", f"SELECT a.vec_id, round({_COS}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("vector_topk_exact", f"SELECT q_id, id, round(score, 6) AS score, rank FROM ({_TOP.format(more='')})")
def vector_topk_exact(spark, d):
    return _shown(O.top_k(*_sets(spark, d), O.exact, 10))


@query("vector_search_filtered", f"SELECT q_id, id, round(score, 6) AS score, rank FROM ({_TOP.format(more='AND a.label = 3')})")
def vector_search_filtered(spark, d):
    rows = table(spark, d, "embeddings")
    return _shown(O.top_k(O.prepared(rows.where("label = 3")), O.prepared(rows.where("vec_id % 50 = 0")), O.exact, 10))


@query("quantize_int8", f"WITH {_CODED} SELECT vec_id, round(scale, 9) AS scale, CAST(list_sum(codes) AS BIGINT) AS total, CAST(list_sum(list_transform(codes, lambda c: abs(c))) AS BIGINT) AS mass FROM e8")
def quantize_int8(spark, d):
    total = lambda f: F.aggregate("codes", F.lit(0).cast("long"), lambda s, c: s + f(c))
    return O.prepared(table(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), F.round("scale", 9).alias("scale"), total(lambda c: c).alias("total"), total(F.abs).alias("mass"))


@query("dequant_error", f"WITH {_CODED} SELECT vec_id, round(list_max(list_transform(list_zip(embedding, codes), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(CAST(z[2] * CAST(CAST(scale AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE)))) / scale, 4) <= 0.5001 AS within FROM e8")
def dequant_error(spark, d):
    back = F.zip_with("v", V.int8_decode(F.col("codes"), F.col("scale")), lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return O.prepared(table(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), (F.round(F.array_max(back) / F.col("scale"), 4) <= 0.5001).alias("within"))


@query("quantize_binary", f"WITH {_E1} SELECT vec_id, array_to_string(bits, '') AS bits FROM e1")
def quantize_binary(spark, d):
    # the lowest bit is the first dimension
    return O.prepared(table(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), F.reverse(F.lpad(F.bin("sign"), 64, "0")).alias("bits"))


@query("quantize_f16", "SELECT vec_id, true AS close FROM embeddings")
def quantize_f16(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").withColumn("back", codecs.decode_f16(codecs.encode_f16(F.col("embedding"))))
    off = F.zip_with("embedding", "back", lambda x, y: F.abs(x - y) <= F.abs(x) / 1024 + 6.2e-5)
    toward = F.zip_with("embedding", "back", lambda x, y: F.abs(y) <= F.abs(x))
    return rows.select("vec_id", (F.forall(off, lambda b: b) & F.forall(toward, lambda b: b)).alias("close"))


@query("vector_hamming", f"WITH {_E1} SELECT a.vec_id, {_HAM} AS distance FROM e1 a JOIN e1 b ON b.vec_id = a.vec_id + 1")
def vector_hamming(spark, d):
    rows = O.prepared(table(spark, d, "embeddings")).select(F.col("id").alias("vec_id"), "sign")
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("sign").alias("other")), "vec_id").select("vec_id", V.hamming(F.col("sign"), F.col("other")).alias("distance"))


_TRUTH = f"truth AS ({_TOP.format(more='')})"


@query("recall_int8", f"""WITH {_CODED}, {_TRUTH}, dec AS (SELECT vec_id, codes AS embedding FROM e8),
found AS ({_TOP.format(more='').replace('embeddings a', 'dec a').replace('embeddings b', 'dec b')})
SELECT count(*) AS hits, count(*) / ((SELECT count(DISTINCT q_id) FROM truth) * 10.0) AS recall FROM found SEMI JOIN truth USING (q_id, id)""")
def recall_int8(spark, d):
    corpus, queries = _sets(spark, d)
    return O.recall(O.top_k(corpus, queries, O.by_int8, 10), O.top_k(corpus, queries, O.exact, 10), 10)


_SIGNS = f"SELECT b.vec_id AS q_id, a.vec_id AS id, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_HAM}, a.vec_id) AS rank FROM e1 a, e1 b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id"


@query("recall_binary", f"WITH {_E1}, {_TRUTH}, found AS (SELECT * FROM ({_SIGNS}) WHERE rank <= 10) SELECT count(*) AS hits, count(*) / ((SELECT count(DISTINCT q_id) FROM truth) * 10.0) AS recall FROM found SEMI JOIN truth USING (q_id, id)")
def recall_binary(spark, d):
    corpus, queries = _sets(spark, d)
    return O.recall(O.top_k(corpus, queries, O.by_sign, 10, descending=False), O.top_k(corpus, queries, O.exact, 10), 10)


@query("vector_rerank", f"WITH {_E1}, wide AS (SELECT q_id, id FROM ({_SIGNS}) WHERE rank <= 100) SELECT q_id, id, round(score, 6) AS score, rank FROM (SELECT w.q_id, w.id, {_COS} AS score, row_number() OVER (PARTITION BY w.q_id ORDER BY {_COS} DESC, w.id) AS rank FROM wide w JOIN embeddings a ON a.vec_id = w.id JOIN embeddings b ON b.vec_id = w.q_id) WHERE rank <= 10")
def vector_rerank(spark, d):
    return _shown(O.rescored(*_sets(spark, d), 10, 10))


_LISTS = f"""centres AS (SELECT vec_id, embedding FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 16),
near AS (SELECT b.vec_id, a.vec_id AS list, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS place FROM centres a, embeddings b),
{_TRUTH},
needed AS (SELECT list_sort(list(q.place))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS probes FROM truth t JOIN near h ON h.vec_id = t.id AND h.place = 1 JOIN near q ON q.vec_id = t.q_id AND q.list = h.list),
met AS (SELECT p.vec_id AS id, q.vec_id AS q_id FROM near p JOIN near q ON q.list = p.list AND p.place = 1 AND q.place <= (SELECT probes FROM needed) AND q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id),
found AS (SELECT q_id, id, score, rank FROM (SELECT q_id, id, {_COS} AS score, row_number() OVER (PARTITION BY q_id ORDER BY {_COS} DESC, id) AS rank FROM met JOIN embeddings a ON a.vec_id = id JOIN embeddings b ON b.vec_id = q_id) WHERE rank <= 10)"""


@query("vector_ann", f"WITH {_LISTS} SELECT q_id, id, round(score, 6) AS score, rank FROM found")
def vector_ann(spark, d):
    """Search in the nearest lists of an inverted index, as many as 95 per cent of the true neighbours need."""
    return _shown(_found(spark, d))


def _found(spark, d):
    corpus, queries = _sets(spark, d)
    return O.approximate(corpus, queries, 10, 16, O.probes_for(corpus, queries, 10, 16, 0.95))


@query("recall_ann", f"WITH {_LISTS} SELECT count(*) AS hits, count(*) / ((SELECT count(DISTINCT q_id) FROM truth) * 10.0) AS recall FROM found SEMI JOIN truth USING (q_id, id)")
def recall_ann(spark, d):
    corpus, queries = _sets(spark, d)
    return O.recall(_found(spark, d), O.top_k(corpus, queries, O.exact, 10), 10)


_REDUCED = "(SELECT vec_id, label, list_transform(range(0, 32), lambda i: CAST(list_sum(list_transform(list_zip(embedding, range(0, 64)), lambda z: CAST(z[1] AS DOUBLE) * (1 - 2 * (bit_count(z[2] & i) % 2)))) / 8 AS FLOAT)) AS embedding FROM embeddings)"


@query("vector_reduce", f"SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS kept FROM {_REDUCED}")
def vector_reduce(spark, d):
    """Half the dimensions, and the share of each vector's squared length that is left."""
    rows = table(spark, d, "embeddings").select("vec_id", V.reduced(F.col("embedding"), 32).alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("kept"))


@query("vector_storage_bytes", "SELECT quant, dim, n, CAST(n * CASE quant WHEN 'f32' THEN dim * 4 WHEN 'f16' THEN dim * 2 WHEN 'int8' THEN dim + 4 ELSE ceil(dim / 8.0) END AS BIGINT) AS bytes FROM (SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1), (SELECT unnest(['f32', 'f16', 'int8', 'binary']) AS quant)")
def vector_storage_bytes(spark, d):
    dims = table(spark, d, "embeddings").groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"))
    kinds = dims.select("dim", "n", F.explode(F.array(*map(F.lit, ("f32", "f16", "int8", "binary")))).alias("quant"))
    return kinds.select("quant", "dim", "n", (F.col("n") * V.storage_bytes(F.col("dim"), F.col("quant"))).alias("bytes"))


@query("effective_rank", "SELECT round(trace * trace / fro, 4) AS rank FROM (SELECT sum(CASE WHEN i = j THEN m END) AS trace, sum(m * m) AS fro FROM (SELECT i, j, sum(CAST(embedding[i] AS DOUBLE) * embedding[j]) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j))")
def effective_rank(spark, d):
    return O.gram_moments(table(spark, d, "embeddings").select(F.col("embedding").alias("v"))).select(F.round(F.col("trace") * F.col("trace") / F.col("fro"), 4).alias("rank"))


_DIST = f"SELECT b.vec_id AS q, 1 - {_COS} AS dist FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0"


@query("relative_contrast", f"SELECT round(avg(mean / near), 4) AS contrast FROM (SELECT q, avg(dist) AS mean, min(CASE WHEN dist > 1e-9 THEN dist END) AS near FROM ({_DIST}) GROUP BY q)")
def relative_contrast(spark, d):
    corpus, queries = _sets(spark, d)
    mean = O.mean_scores(corpus, queries).select("q_id", (1 - F.col("total") / F.col("n")).alias("mean"))
    near = O.best(corpus, queries, O.exact, 1, own=True, gap=1e-9).groupBy("q_id").agg(F.min(1 - F.col("score")).alias("near"))
    return mean.join(near, "q_id", "left").agg(F.round(F.avg(F.col("mean") / F.coalesce("near", F.lit(1e-9))), 4).alias("contrast"))


@query("corpus_similarity", f"SELECT round(avg(CASE WHEN rank = 1 THEN score END), 6) AS top1, round(avg(CASE WHEN rank <= 10 THEN score END), 6) AS top10, round(avg(score), 6) AS mean FROM (SELECT row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rank, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)")
def corpus_similarity(spark, d):
    corpus, queries = _sets(spark, d)
    best = O.top_k(corpus, queries, O.exact, 10).agg(F.avg(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.avg("score").alias("b"))
    every = O.mean_scores(corpus, queries).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    named = queries.select(F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("norm").alias("q_norm"))
    own = corpus.join(named, F.col("id") == F.col("q_id")).select(O.exact().alias("score")).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("own"), F.count("score").alias("owns"))
    mean = every.crossJoin(own).select(F.try_divide(F.col("total") - F.col("own"), F.col("n") - F.col("owns")).alias("c"))
    return best.crossJoin(mean).select(F.round("a", 6).alias("top1"), F.round("b", 6).alias("top10"), F.round("c", 6).alias("mean"))


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(3 * x AS DOUBLE) / (3 * sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))))), 4) AS total FROM embeddings")
def vector_normalize(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", V.normalize(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query("vector_f32_bytes", "SELECT vec_id, len(embedding) * 4 AS bytes, array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100000000 + 0.5) AS BIGINT)), ',') AS decoded FROM embeddings")
def vector_f32_bytes(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding").withColumn("b", codecs.encode_f32(F.col("embedding")))
    return rows.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), F.array_join(F.transform(codecs.decode_f32(F.col("b")), lambda x: F.floor(x.cast("double") * 100_000_000 + 0.5)), ",").alias("decoded"))


@query("vector_remove", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label")
def vector_remove(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.join(rows.where("vec_id % 3 = 0").select("vec_id"), "vec_id", "left_anti").groupBy("label").agg(F.count("*").alias("n"))
