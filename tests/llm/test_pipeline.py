"""The pipeline against plain statements of its stages, over a whole table."""

import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_dedup import join, passages

from keelspark.llm import bpe, decontaminate, jaccard, langid, queries, simhash, suffix_dedup


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    return docs, items


def shingles(text):
    """Lower-case five-word shingles of a text, shorter texts whole."""
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(texts):
    """The least key of each text's component: equal shingle sets, or a Jaccard similarity of 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    order = sorted(sets)
    pairs = []
    for k, i in enumerate(order):
        for j in order[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a == b or both * 5 >= (len(a) + len(b) - both) * 4 and both:
                pairs.append((j, i))
    return join(pairs, order)


def cut(texts):
    """Texts without the runs of over 50 words that another of them holds."""
    keys = list(texts)
    spans = passages([texts[i].encode() for i in keys], 51)
    return {i: suffix_dedup.kept(texts[i].encode(), s).decode() for i, s in zip(keys, spans)}


def test_stages(spark, sf, tables):
    docs, items = tables
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = langid.train(docs)
    names, _ = model.predict(list(rows.values()))
    rows = {i: t for (i, t), n in zip(rows.items(), names) if n != "und"}
    root = near(rows)
    rows = cut({i: t for i, t in rows.items() if root[i] == i})
    m = decontaminate.Matcher([(r.item_id, r.text) for r in items])
    rows = {i: t for i, t in rows.items() if not m.find(t)}
    codec = bpe.codec(bpe.default_path())
    want = {i: (len(codec.encode_bytes(t)) // 4, hashlib.sha256(codec.encode_bytes(t)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_passages_of_over_fifty_words_go(spark, sf, tables):
    """Passages of 51 to 60 words planted in otherwise different texts are gone, the texts around them and clean texts stay."""
    docs, _ = tables
    rng = random.Random(55)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    planted = [some(n) for n in range(51, 61)]
    rows, want = [], {}
    for i in range(60):
        before, after = some(rng.randint(20, 90)), some(rng.randint(20, 90))
        # every other one keeps fifty words of a passage only
        middle = planted[i % 10] if i % 2 == 0 else f"w{i} {' '.join(planted[i % 10].split()[:50])} v{i}"
        rows.append((i, f"{before} {middle} {after}", "en", "s", 1))
        want[i] = f"{before}  {after}" if i % 2 == 0 else rows[-1][1]
    got = corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame(rows, docs.schema), sf).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_stage_columns(spark, sf, tables):
    docs, _ = tables
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_odd_rows(spark, sf, tables):
    """Each stage's defined results for nulls, empty texts, ties, repeated rows and very long texts."""
    docs, items = tables
    same = "the same words again " * 60
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(200_000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", None, None, 0), (2, same, "en", "s", 9), (3, same, "en", "s", 9), (3, same, "en", "s", 9), (4, "\U0001f600é" * 500, None, None, None), (5, long, "en", None, 1), (None, same, "en", "s", 2)]
    df = spark.createDataFrame(rows, docs.schema)
    ids = lambda out: sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["language_id"](spark, df, sf)) == [2, 3, 3, 4, 5, None]
    # null and empty texts are copies of each other; rows without doc_id stay, a repeated doc_id keeps its rows
    assert ids(stages["simhash_near_dedup"](spark, df, sf)) == [1, 1, 2, 4, 5, None, None]
    told = stages["suffix_array_dedup"](spark, df, sf).collect()
    assert len(told) == len(rows)
    texts = {(r.doc_id, r.text) for r in told}
    assert texts == {(r[0], r[1]) for r in rows}
    passage = " ".join(f"w{i}" for i in range(60))
    shared = spark.createDataFrame([(1, f"one {passage} two", "en", "s", 1), (2, passage, "en", "s", 1), (2, passage, "en", "s", 1)], docs.schema)
    assert sorted((r.doc_id, r.text) for r in stages["suffix_array_dedup"](spark, shared, sf).collect()) == [(1, "one  two"), (2, ""), (2, "")]
    item = items[0].text
    leaked = spark.createDataFrame([*rows, (7, f"{long} {item}", "en", "s", 1), (8, item, None, None, None), (8, item, None, None, None)], docs.schema)
    assert ids(stages["benchmark_decontamination"](spark, leaked, sf)) == ids(df)
    tokens = stages["bpe_tokens"](spark, df, sf).collect()
    assert len(tokens) == len(rows) and {r.n_tokens for r in tokens if r.doc_id == 1} == {0}


def test_extra_columns(spark, sf, tables):
    """Operators behind the stages keep extra columns, whatever their names."""
    docs, items = tables
    extra = ["key", "spans", "row", "node", "fp", "component_id", "chunk", "__key"]
    df = docs.select("*", *[F.lit(f"x-{c}").alias(c) for c in extra])
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id long, text string")
    for fn in (langid.keep_identified, jaccard.keep_first, simhash.keep_first, suffix_dedup.remove_repeats, lambda d: decontaminate.keep_clean(d, bench)):
        out = fn(df)
        assert out.columns == df.columns
        assert out.where(" or ".join(f"{c} <> 'x-{c}'" for c in extra)).count() == 0 and out.count() > 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and set(queries.queries()) <= set(names)
    assert [f"op{n}_" for n in range(1, 11)] == [x[: x.index("_") + 1] for x in queries.queries()]
