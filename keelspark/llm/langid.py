"""Language identification by a linear-chain conditional random field over the words of a text.

Each word is described by its affixes, its character n-grams and, where it is frequent in the training rows, itself (lexicon).  Emission
weights of these and the transitions between labels are learned together by maximising the conditional likelihood; forward-backward
then gives every word's label distribution, so that code-switched text gets a label per word.  A document's language is the label with the
largest mean marginal, its score that mean.

Training uses a bounded, deterministic sample of labelled rows (ROWS per label, MOST_ROWS in all but one of each label at least, texts up to
TRAIN_BYTES; a label that has longer texts alone is learned from its shortest one) outside the held-out fifth; every label is learned.  The model
has a size bounded by that sample and travels in the closure.  Prediction reads the text alone, is
row-by-row and handles words in blocks whose transfer matrices are composed, so a very long text costs no more per word than a short one.

Defined results: null text or no letter: `und`, score 0; no labelled rows at all: `und` everywhere; a null doc_id counts as the
empty text in the fold's checksum; ties go to the label that sorts first.
"""

from __future__ import annotations

import uuid
from collections import Counter
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

ROWS, MOST_ROWS, TRAIN_BYTES = 120, 7680, 16_384
ROUNDS, RATE, RIDGE = 60, 0.15, 1e-4
LEXICON = 400
BLOCK = 32
MEMO = 150_000
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words(text: str) -> list[str]:
    return _WORDS(text.lower())


def marks(word: str) -> list[str]:
    """The features of a word, but for the lexicon."""
    w = f"<{word}>"
    return [*map("".join, zip(w, w[1:], w[2:])), "^" + word[:2], "^" + word[:4], "$" + word[-2:], "$" + word[-4:]]


class Chain:
    """Forward and backward over blocks: scores are relative, each step is normalised."""

    def __init__(self, lengths: np.ndarray, labels: int = 1, block: int = BLOCK):
        # a block holds a matrix of labels by labels: with many labels, longer blocks keep them as small as the words' own scores
        block = max(block, labels * labels // 8)
        self.block, self.n = block, int(lengths.sum())
        per = -(-lengths // block)
        self.blocks = int(per.sum())
        self.first = np.cumsum(per) - per
        self.per = per
        begin = np.cumsum(lengths) - lengths
        inside = np.arange(self.n) - np.repeat(begin, lengths)
        #: place of each word in the padded (block, step) grid
        self.place = (np.repeat(self.first, lengths) + inside // block) * block + inside % block
        self.real = np.zeros(self.blocks * block, dtype=bool)
        self.real[self.place] = True
        self.real = self.real.reshape(self.blocks, block)

    def run(self, emit: np.ndarray, trans: np.ndarray, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each word, and the expected transition counts where they are wanted."""
        k = emit.shape[1]
        x = np.ones((self.blocks * self.block, k))
        x[self.place] = np.exp(emit - emit.max(1, keepdims=True))
        x = x.reshape(self.blocks, self.block, k)
        t = np.exp(trans)
        # transfer matrix of each block
        p = np.broadcast_to(np.eye(k), (self.blocks, k, k)).copy()
        for s in range(self.block):
            on = self.real[:, s]
            if not on.any():
                break
            step = (p[on] @ t) * x[on, s, None, :]
            p[on] = step / step.sum((1, 2), keepdims=True)
        # the vectors at the blocks' ends, along each text
        left, right = np.full((self.blocks, k), 1.0 / k), np.full((self.blocks, k), 1.0 / k)
        order = np.argsort(-self.per, kind="stable")
        per = self.per[order]
        for j in range(1, int(per[0]) if len(per) else 0):
            live = order[: np.searchsorted(-per, -j)]
            at = self.first[live] + j
            v = np.einsum("bi,bij->bj", left[at - 1], p[at - 1])
            left[at] = v / v.sum(1, keepdims=True)
            back = self.first[live] + self.per[live] - 1 - j
            v = np.einsum("bij,bj->bi", p[back + 1], right[back + 1])
            right[back] = v / v.sum(1, keepdims=True)
        # inside the blocks
        alpha = np.empty_like(x)
        v = left
        for s in range(self.block):
            on = self.real[:, s, None]
            w = (v @ t) * x[:, s]
            v = np.where(on, w / w.sum(1, keepdims=True), v)
            alpha[:, s] = v
        gamma = np.empty_like(x)
        counts = np.zeros((k, k))
        v = right
        for s in range(self.block - 1, -1, -1):
            on = self.real[:, s, None]
            g = alpha[:, s] * v
            gamma[:, s] = g / g.sum(1, keepdims=True)
            ahead = x[:, s] * v
            if counted:
                prev = alpha[:, s - 1] if s else left
                pair = prev[:, :, None] * t * ahead[:, None, :]
                counts += (pair / pair.sum((1, 2), keepdims=True))[on[:, 0]].sum(0)
            w = ahead @ t.T
            v = np.where(on, w / w.sum(1, keepdims=True), v)
        return gamma.reshape(-1, k)[self.place], counts

    def marginals(self, emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
        return self.run(emit, trans, counted=False)[0]


class Model:
    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.labels, self.index, self.trans = labels, index, trans
        self.weights = np.concatenate([weights, np.zeros((1, weights.shape[1]), dtype=np.float32)])
        self.key = uuid.uuid4().hex

    def emissions(self, distinct: list[str]) -> np.ndarray:
        """A row of label scores for each word."""
        get, cols, ends = self.index.get, [], []
        # unknown features count in an extra row of zeros
        none = len(self.weights) - 1
        for w in distinct:
            cols += [get(m, none) for m in marks(w)]
            cols.append(get("=" + w, none))
            ends.append(len(cols))
        sums = np.concatenate([np.zeros((1, len(self.labels)), dtype=np.float32), np.cumsum(self.weights[cols], axis=0, dtype=np.float64)]) if cols else np.zeros((1, len(self.labels)))
        ends = np.array(ends)
        return sums[ends] - sums[np.append(0, ends[:-1])]

    def _scored(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        memo = self.__dict__.setdefault("memo", {})
        rows = self.__dict__.setdefault("rows", np.zeros((1 << 14, len(self.labels))))
        fresh = list(set().union(*texts) - memo.keys())
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = list(set().union(*texts))
        if fresh:
            n = len(memo)
            while len(rows) < n + len(fresh):
                rows = np.concatenate([rows, np.zeros_like(rows)])
            rows[n : n + len(fresh)] = self.emissions(fresh)
            memo |= zip(fresh, range(n, n + len(fresh)))
        self.rows = rows
        place = np.fromiter(map(memo.__getitem__, chained.from_iterable(texts)), dtype=np.int64)
        return rows[place], np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))

    def label_words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The label distribution of every word of every (non-empty) text."""
        emit, lengths = self._scored(texts)
        return np.split(Chain(lengths, len(self.labels)).marginals(emit, self.trans), np.cumsum(lengths)[:-1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores
        wait: list[int] = []
        held: list[list[str]] = []
        at_once = 800_000 // max(4, len(self.labels))
        size = 0
        for i, text in enumerate(texts):
            found = words(text) if text else []
            if found:
                wait.append(i)
                held.append(found)
                size += len(found)
            if held and (size > at_once or i == len(texts) - 1):
                emit, lengths = self._scored(held)
                gamma = Chain(lengths, len(self.labels)).marginals(emit, self.trans)
                mean = np.add.reduceat(gamma, np.cumsum(lengths) - lengths) / lengths[:, None]
                for j, row in zip(wait, mean):
                    best = int(row.argmax())
                    names[j], scores[j] = self.labels[best], float(min(1.0, row[best]))
                wait, held, size = [], [], 0
        return names, scores


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """rows: text, label.  Texts are cut into runs of a few dozen words, and runs of different labels follow each other, so that
    transitions between labels are seen too."""
    labels = sorted({y for _, y in rows})
    if not labels:
        return Model([], {}, np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)))
    code = {y: i for i, y in enumerate(labels)}
    split = sorted(((words(t), code[y]) for t, y in rows), key=lambda r: (len(r[0]), r[1], r[0][:3]))
    lexicon: set[str] = set()
    for y in range(len(labels)):
        often = Counter(w for ws, z in split if z == y for w in ws)
        lexicon |= {w for w, _ in sorted(often.items(), key=lambda c: (-c[1], c[0]))[:LEXICON]}
    rng = np.random.default_rng(8)
    runs = []
    for ws, y in split:
        a = 0
        while a < len(ws):
            b = a + int(rng.integers(20, 120))
            runs.append((ws[a:b], y))
            a = b
    if not runs:
        return Model([], {}, np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0)))
    runs = [runs[i] for i in rng.permutation(len(runs))]
    distinct = sorted({w for ws, _ in runs for w in ws})
    seen = Counter(m for w in distinct for m in marks(w))
    index = {m: i for i, m in enumerate([*sorted(m for m, n in seen.items() if n > 1), *(f"={w}" for w in sorted(lexicon))])}
    number = {w: i for i, w in enumerate(distinct)}
    cols, owner = [], []
    for i, w in enumerate(distinct):
        here = [index[m] for m in marks(w) if m in index] + ([index[f"={w}"]] if w in lexicon else [])
        cols += here
        owner += [i] * len(here)
    cols, owner = np.array(cols, dtype=np.int64), np.array(owner, dtype=np.int64)
    place = np.array([number[w] for ws, _ in runs for w in ws])
    truth = np.repeat([y for _, y in runs], [len(ws) for ws, _ in runs])
    # sequences of eight runs
    lengths = np.array([len(ws) for ws, _ in runs])
    k, d, n = len(labels), len(index), len(place)
    chain = Chain(np.add.reduceat(lengths, np.arange(0, len(lengths), 8)), k)
    empirical = np.zeros((k, k))
    starts = np.cumsum(lengths)[7::8]
    joined = np.ones(n - 1, dtype=bool)
    joined[starts[starts < n] - 1] = False
    np.add.at(empirical, (truth[:-1][joined], truth[1:][joined]), 1)
    weights, trans = np.zeros((d, k)), np.eye(k) * 2
    m1, m2 = [np.zeros_like(weights), np.zeros_like(trans)], [np.zeros_like(weights), np.zeros_like(trans)]
    for step in range(1, rounds + 1):
        word_emit = np.stack([np.bincount(owner, weights[cols, j], minlength=len(distinct)) for j in range(k)], 1)
        gamma, expected = chain.run(word_emit[place], trans)
        gamma[np.arange(n), truth] -= 1
        by_word = np.stack([np.bincount(place, gamma[:, j], minlength=len(distinct)) for j in range(k)], 1) / n
        slope = np.stack([np.bincount(cols, by_word[owner, j], minlength=d) for j in range(k)], 1) + RIDGE * weights / 10
        slope_t = (expected - empirical) / n + RIDGE * trans
        for i, (value, g) in enumerate(((weights, slope), (trans, slope_t))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            value -= RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-9)
    return Model(labels, index, weights.astype(np.float32), trans - trans.max())


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, rows: int = ROWS, most: int = MOST_ROWS) -> list[tuple[str, str]]:
    """At most `rows` different labelled texts for each label, chosen by a hash, and fewer where there are very many labels (`most` in all, but one
    each).  The first pass counts; the second keeps about four times as many as needed before the exact cut, so that no task sends more than it
    has to.  Copies of a text fall together under the hash, so the chance comes from the number of different texts."""
    fit_ = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (~held_out()).alias("use")).where("use and lang is not null and text <> '' and lang <> 'und'")
    fits = F.octet_length("text") <= TRAIN_BYTES
    counts = fit_.groupBy("lang").agg(F.count_distinct(F.when(fits, F.xxhash64("text"))).alias("texts"), F.min(F.octet_length("text")).alias("least")).collect()
    if not counts:
        return []
    rows = max(1, min(rows, most // len(counts)))
    span = 1 << 30
    table_ = [(r["lang"], min(span, 4 * span * rows // max(r["texts"], 1)), 0 if r["texts"] else r["least"]) for r in counts]
    chances = F.broadcast(docs.sparkSession.createDataFrame(table_, "lang string, chance long, alone long"))
    dice = F.xxhash64("text", "lang")
    near = fit_.join(chances, "lang").where((fits & (F.pmod(dice, F.lit(span)) < F.col("chance"))) | (F.octet_length("text") == F.col("alone")))
    near = near.select("text", "lang", dice.alias("dice"), "alone").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "text"))
    wanted = F.when(F.col("alone") > 0, F.lit(1)).otherwise(F.lit(rows))
    return [(r["text"], r["lang"]) for r in near.withColumn("rank", rank).where(F.col("rank") <= wanted).select("text", "lang").collect()]


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    common.prepare(docs.sparkSession)
    return fit(training_rows(docs, rows))


_WORKERS: dict[str, Model] = {}


def _warm(model: Model) -> Model:
    """The worker's copy of the model, whose memo of words outlives a task."""
    if model.key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[model.key] = model
    return _WORKERS[model.key]


def predict_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        names, scores = _warm(model).predict(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

    return common.map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double", arrow)


def label_words(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, words: array of (word, lang, score), for code-switched text."""
    model = model or train(docs)
    arrow = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])))])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out = []
        for text in batch.column("text").to_pylist():
            found = words(text or "")
            if not found or not model.labels:
                out.append([{"word": w, "lang": "und", "score": 0.0} for w in found])
                continue
            (gamma,) = model.label_words([found])
            best = gamma.argmax(1)
            out.append([{"word": w, "lang": model.labels[b], "score": float(g[b])} for w, b, g in zip(found, best.tolist(), gamma)])
        return {"doc_id": batch.column("doc_id"), "words": out}

    return common.map_batches(common.text_of(docs), run, "doc_id long, words array<struct<word: string, lang: string, score: double>>", arrow)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows whose text has a language; lang becomes the predicted one, all other columns stay as they are.  Null texts and texts without a
    letter go; without labelled rows, or without a column lang, nothing is learned and no row has a language; repeated rows are judged alike."""
    plain = docs.withColumn("lang", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string"))
    model = train(plain)
    at = plain.columns.index("text")
    to = plain.columns.index("lang")

    def run(batches):
        for batch in batches:
            names, _ = _warm(model).predict(batch.column(at).to_pylist())
            batch = batch.set_column(to, batch.schema.field(to).name, pa.array(names, type=batch.schema.field(to).type))
            keep = pa.array([n != "und" for n in names], type=pa.bool_())
            yield batch.filter(keep)

    return plain.mapInArrow(run, plain.schema)
