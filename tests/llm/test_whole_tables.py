"""Every operator over odd tables, and whole results against plain versions where SQL has none."""

import html.parser
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelspark.llm import bpe, chat_format, decontaminate, html_extract, jaccard, langid, license_scan, media, quality, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside or return
CLASH = ["key", "spans", "row", "node", "keys", "fp", "at", "component_id", "least", "times", "chunk", "mark", "dice", "ids", "licenses", "n_tokens", "n_bytes", "score", "held_out", "edits", "host", "layout", "wrappers", "path", "salt", "own", "rank", "copies"]


def odd_documents():
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(150_000))
    plain = [" ".join(word() for _ in range(rng.randint(1, 90))) for _ in range(20)]
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s", None]), len(t)) for i, t in enumerate(plain)]
    rows += [(100, None, None, None, None), (101, "", "aa", "s", 0), (102, " \n\t ", "bb", None, 4), (103, long, "aa", "s", len(long)), (103, long, "aa", "s", len(long)), (None, plain[0], "aa", "s", 1), (None, None, None, None, None), (0, plain[0], "aa", "s", len(plain[0]))]
    return rows + [(104, "All rights reserved.\n" + plain[1], "aa", "s", 5), (105, "12345 !!! ???", None, None, None), (106, "x" * 300_000, None, "s", 3), (107, "\U0001f600" * 500, None, "s", 2)]


def bench_items(spark):
    return spark.createDataFrame([(1, "one item of the benchmark that no document has in it at all"), (1, None), (None, "x"), (2, "")], "item_id long, text string")


def label_rows(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(15)] + [(0, 0, False), (None, 1, True), (3, None, None)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


OPERATORS = {
    "op1": (lambda s, d: bpe.token_digests(d), True),
    "op2": (lambda s, d: license_scan.scan(d), True),
    "op3": (lambda s, d: quality.score(d, label_rows(s)), True),
    "op4": (lambda s, d: decontaminate.leaks(d, bench_items(s)), False),
    "op7": (lambda s, d: simhash.op7(d), True),
    "op8": (lambda s, d: langid.predict_languages(d), True),
    "op9": (lambda s, d: suffix_dedup.op9(d), True),
    "op10": (lambda s, d: media.media_digests(d), True),
    "near": (lambda s, d: jaccard.near_copies(d), True),
}


def told(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_documents(spark, name):
    fn, whole = OPERATORS[name]
    rows = odd_documents()
    plain = spark.createDataFrame(rows, DOCS).repartition(3)
    out = fn(spark, plain)
    want = told(out)
    if whole:
        assert len(want) == len(rows)
    # extra columns with clashing names, and another order of rows, change nothing
    extra = plain.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH]).repartition(5)
    again = fn(spark, extra)
    assert again.columns == out.columns and told(again) == want
    empty = fn(spark, plain.limit(0))
    assert empty.columns == out.columns and empty.count() == 0
    nulls = fn(spark, spark.createDataFrame([(None,) * 5] * 3, DOCS))
    assert nulls.count() == (3 if whole else 0)


def test_odd_pages(spark):
    rng = random.Random(78)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    long = "<body><article>" + "".join(f"<p>{line(6)}</p>" for _ in range(20_000)) + "</article></body>"
    rows = [(1, "http://a.example/1", long), (1, "http://a.example/1", long), (2, None, None), (None, None, ""), (3, "not a url", "<p>x"), (4, "http://a.example/2", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = told(html_extract.main_text(df))
    assert len(want) == len(rows) and max(r[3] for r in want) > 600_000
    extra = df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(4)
    assert told(html_extract.main_text(extra)) == want
    assert html_extract.main_text(df.limit(0)).count() == 0
    assert [tuple(r) for r in html_extract.main_text(spark.createDataFrame([(None, None, None)], df.schema)).collect()] == [(None, None, "", 0)]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a" * 2_000_000), (1, 1, "assistant", "b" * 2_000_000), (2, 0, None, None), (None, None, None, None), (3, 0, "user", ""), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = told(chat_format.format_digests(df))
    assert len(want) == 4
    extra = df.select("*", *[F.lit("x").alias(c) for c in CLASH])
    assert told(chat_format.format_digests(extra.repartition(4))) == want
    assert chat_format.format_digests(df.limit(0)).count() == 0


class Article(html.parser.HTMLParser):
    """The blocks of the article element, by the standard library's parser; unclosed inline marks are no blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.run = False, [], []

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif self.inside and tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote"):
            self.flush()
        elif tag == "br":
            self.run.append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.flush()
            self.inside = False
        elif self.inside and tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote"):
            self.flush()

    def handle_data(self, data):
        if self.inside:
            self.run.append(data)


def test_all_pages_against_a_plain_reader(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {(r.page_id, r.url): r.text for r in html_extract.main_text(pages).collect()}
    rows = pages.collect()
    for r in rows:
        reader = Article()
        reader.feed(r.html or "")
        reader.close()
        assert got[r.page_id, r.url] == "\n\n".join(reader.blocks)
    assert len(got) == len({(r.page_id, r.url) for r in rows})


def plain_prediction(model, text):
    """Forward and backward word by word, scores as plain sums."""
    found = langid.words(text or "")
    if not found:
        return "und", 0.0
    k = len(model.labels)
    emit = np.array([sum((model.weights[model.index[m]].astype(float) for m in [*langid.marks(w), f"={w}"] if m in model.index), np.zeros(k)) for w in found])
    trans = np.exp(model.trans)
    emit = np.exp(emit - emit.max(1, keepdims=True))
    alpha, v = [], np.full(k, 1.0 / k)
    for e in emit:
        v = (v @ trans) * e
        v = v / v.sum()
        alpha.append(v)
    beta, v = [None] * len(emit), np.full(k, 1.0 / k)
    for i in range(len(emit) - 1, -1, -1):
        beta[i] = v
        v = trans @ (emit[i] * v)
        v = v / v.sum()
    gamma = np.array([a * b / (a * b).sum() for a, b in zip(alpha, beta)]).mean(0)
    return model.labels[int(gamma.argmax())], min(1.0, float(gamma.max()))


def test_all_languages_against_a_plain_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(docs, model).collect()}
    rows = docs.collect()
    for r in rows:
        name, score = plain_prediction(model, r.text)
        assert got[r.doc_id][0] == name and abs(got[r.doc_id][1] - score) < 1e-5
    held = [r for r in rows if r.lang and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(got[r.doc_id][0] == r.lang for r in held) >= 0.95 * len(held)


def test_all_quality_scores_against_plain_sums(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    # the fit does not depend on how rows are dealt out
    other = quality.fit(docs.repartition(7), labels.repartition(3))
    got = {r.doc_id: r for r in quality.score(docs, labels, model).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for r in docs.collect():
        text, meta = quality.TextView().rows([r.text or ""]), quality.MetaView.rows([(r.source, r.lang, r.n_chars)])
        for t, name in (("quality", "quality_score"), ("toxic", "toxic_score")):
            (w, m), c = model.parts[t]
            one = sum(float(w[i]) * x for i, x in zip(text[0].tolist(), text[1].tolist()))
            two = sum(float(m[i]) for i in meta[0].tolist())
            assert abs(getattr(got[r.doc_id], name) - sigmoid(one * c[0] + two * c[1] + c[2])) < 1e-6
    for t in quality.TARGETS:
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model.parts[t][0], other.parts[t][0]))
        assert np.allclose(model.parts[t][1], other.parts[t][1], atol=1e-4)
