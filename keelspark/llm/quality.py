"""Document quality and toxicity by co-training.

Two views of a document are kept apart: what its text says (hashed words and measures of its form) and what its page tells about it
(source, declared language, declared length).  A classifier for each view learns from a bounded sample of labelled rows; over some rounds each
one labels the unlabelled documents it is most sure of, in the label's own proportion, for the other.  Both views are then
calibrated on labelled rows that neither has learned from, combined with weights fitted on those rows, and applied to every document.

The labelled sample (LABELLED rows), the pool of unlabelled rows that pseudo-labels are drawn from (POOL rows, as the published method keeps one) and
the features (2**BITS words) are documented bounds of the fit, chosen by hashes of doc_id and content.  The sample's features are made on the executors from
whole texts of any length; only these travel to the driver.  Scoring reads every whole text row by row.  A view that tells nothing gets a weight
near zero by itself.

Defined results: null text is empty; documents without a label are scored like all others; labels of unknown documents are ignored; where a
doc_id is labelled twice its least label counts; with no labels, or one kind only, the score is that kind's share (0.5 for none); a null source
or language is a value of its own.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LABELLED, POOL = 6000, 3000
BITS, ROUNDS, TAKE = 15, 3, 120
#: a word tells the kinds apart beyond this log-likelihood ratio; at most so many do
SURE, MOST = 12.0, 500
TARGETS = ("quality", "toxic")
_FORM = 16
_META = 256


_SPACED = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) in "'_" else 32 for c in range(256))
_KINDS = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "odd": b"!?*#$%&|@^~<>{}[]+=\\/", "line": b"\n"}
_LOW = (1 << BITS) - 1


class TextView:
    """Hashed words and word beginnings (1 + log count), and measures of form."""

    size = (2 << BITS) + _FORM

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: columns, values, where each row ends."""
        cols, vals, ends = [], [], []
        check = zlib.crc32
        for text in texts:
            raw = text.encode("utf-8", "replace")
            tokens = text.lower().encode("utf-8", "replace").translate(_SPACED).split()
            seen = Counter(tokens)
            here = np.array([check(t) & _LOW for t in seen] + [(check(t[:5]) & _LOW) | 1 << BITS for t in seen], dtype=np.int64)
            times = np.fromiter(seen.values(), dtype=np.float64, count=len(seen))
            weight = 1 + np.log(times) if len(times) else times
            cols += [here, np.arange(2 << BITS, self.size)]
            vals += [np.tile(weight, 2), self.form(raw, len(tokens), len(seen), float(times.max()) if len(times) else 0.0)]
            ends.append((ends[-1] if ends else 0) + len(here) + _FORM)
        return (np.concatenate(cols), np.concatenate(vals), np.array(ends)) if texts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    @staticmethod
    def form(raw: bytes, n: int, distinct: int, most: float) -> np.ndarray:
        n, size = max(n, 1), max(len(raw), 1)
        count = {k: size - len(raw.translate(None, kind)) for k, kind in _KINDS.items()} if raw else dict.fromkeys(_KINDS, 0)
        lines = raw.split(b"\n")
        letters = max(count["upper"] + count["lower"], 1)
        return np.array([
            1.0, math.log1p(n) / 8, distinct / n, most / n, 1 - len(set(lines)) / len(lines), count["upper"] / letters,
            count["odd"] / size * 10, count["digit"] / size * 10, size / n / 8, count["line"] / n * 10, math.sqrt(max(0.0, 1 - distinct / n)), min(1.0, n / 50),
            math.sqrt(count["odd"] / size), math.sqrt(count["upper"] / letters), math.sqrt(raw.count(b"|") / size), max(0.0, 1 - distinct * math.log1p(n) / n / 2),
        ]) * 6


class MetaView:
    """Hashed source and language, and the declared length in powers of two."""

    size = 1 + 3 * _META

    @staticmethod
    def rows(meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = []
        for source, lang, n in meta:
            told = (source, lang, None if n is None else max(0, int(n)).bit_length())
            cols += [0, *(1 + _META * i + zlib.crc32(repr(x).encode()) % _META for i, x in enumerate(told))]
        return np.array(cols, dtype=np.int64), np.ones(len(cols)), np.arange(4, len(cols) + 1, 4)


def dot(rows: tuple, weights: np.ndarray) -> np.ndarray:
    cols, vals, ends = rows
    sums = np.concatenate([[0.0], np.cumsum(weights[cols] * vals)])
    return sums[ends] - sums[np.append(0, ends[:-1])] if len(ends) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def informative(rows: tuple, y: np.ndarray, size: int) -> np.ndarray:
    """Which columns tell the two kinds apart: those whose presence has a log-likelihood ratio over SURE, at most MOST of them, and all
    that nearly every row has (measures)."""
    cols, _, ends = rows
    own = np.repeat(y, np.diff(np.append(0, ends)))
    n1, n0 = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
    a, b = np.minimum(np.bincount(cols, own, minlength=size), n1), np.minimum(np.bincount(cols, 1 - own, minlength=size), n0)

    def part(seen: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(wanted, 1e-9)), 0.0)

    share = (a + b) / (n1 + n0)
    ratio = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    level = max(SURE, float(np.partition(ratio, -MOST)[-MOST])) if len(ratio) > MOST else SURE
    return (ratio >= level) | (share > 0.999)


def logistic(rows: tuple, y: np.ndarray, size: int, rounds: int = 200, rate: float = 0.1, ridge: float = 3e-5) -> np.ndarray:
    """Weights by Adam over all rows; both kinds weigh the same."""
    cols, vals, ends = rows
    owner = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    keep = informative(rows, y, size)[cols]
    cols, vals, owner = cols[keep], vals[keep], owner[keep]
    ends = np.searchsorted(owner, np.arange(len(ends)), side="right")
    rows = cols, vals, ends
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        g = np.bincount(cols, ((_sigmoid(dot(rows, w)) - y) * weight)[owner] * vals, minlength=size) + ridge * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def _take(rows: tuple, which: np.ndarray) -> tuple:
    cols, vals, ends = rows
    begin = np.append(0, ends[:-1])
    size = (ends - begin)[which]
    place = np.repeat(begin[which] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return cols[place], vals[place], np.cumsum(size)


def _glue(a: tuple, b: tuple) -> tuple:
    return np.append(a[0], b[0]), np.append(a[1], b[1]), np.append(a[2], b[2] + (a[2][-1] if len(a[2]) else 0))


def calibrate(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the calibrated combination: a logistic regression on the views' scores, unweighted, so that it gives probabilities."""
    x = np.column_stack([scores, np.ones(len(scores))])
    spread = scores.std(0)
    # a view that says the same of every row gets no weight
    scale = np.append(np.where(spread < 1e-3, np.inf, spread), 1.0)
    x, w = x / scale, np.append(np.ones(scores.shape[1]), 0.0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.05 * (w[:-1] @ w[:-1]))

    ridge = np.append(np.full(scores.shape[1], 0.1), 1e-6)
    for _ in range(40):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w / scale


def cotrain(rows: tuple[tuple, tuple], y: np.ndarray, pool: tuple[tuple, tuple], rounds: int = ROUNDS, take: int = TAKE) -> tuple[list[np.ndarray], np.ndarray]:
    """The two views' weights, and those of their combination."""
    sizes = (TextView.size, MetaView.size)
    fold = np.arange(len(y)) % 4 == 0
    if len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return [np.zeros(s) for s in sizes], np.array([0.0, 0.0, math.log(share / (1 - share))])
    own = [(_take(r, np.flatnonzero(~fold)), y[~fold]) for r in rows]
    free = np.ones(len(pool[0][2]), dtype=bool)
    share = y.mean()
    weights = [logistic(r, t, s) for (r, t), s in zip(own, sizes)]
    for _ in range(rounds):
        for v in (0, 1):
            open_ = np.flatnonzero(free)
            score = dot(_take(pool[v], open_), weights[v])
            order = np.argsort(score, kind="stable")
            up, down = order[::-1][: max(1, round(take * share))], order[: max(1, round(take * (1 - share)))]
            # only what this view is sure of
            up, down = up[score[up] > 2], down[score[down] < -2]
            got, label = np.append(open_[up], open_[down]), np.append(np.ones(len(up)), np.zeros(len(down)))
            if len(got):
                free[got] = False
                other = 1 - v
                own[other] = (_glue(own[other][0], _take(pool[other], got)), np.append(own[other][1], label))
        weights = [logistic(r, t, s) for (r, t), s in zip(own, sizes)]
    scores = np.column_stack([dot(_take(r, np.flatnonzero(fold)), w) for r, w in zip(rows, weights)])
    return weights, calibrate(scores, y[fold])


class Model:
    def __init__(self, parts: dict[str, tuple[list[np.ndarray], np.ndarray]]):
        self.parts, self.key = {t: ([w.astype(np.float32) for w in ws], c) for t, (ws, c) in parts.items()}, uuid.uuid4().hex
        self.view = TextView()

    def score(self, texts: list[str], meta: list[tuple]) -> dict[str, np.ndarray]:
        a, b = self.view.rows(texts), MetaView.rows(meta)
        return {t: _sigmoid(dot(a, ws[0]) * c[0] + dot(b, ws[1]) * c[1] + c[2]) for t, (ws, c) in self.parts.items()}


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    col = lambda n, kind: (F.col(n) if n in have else F.lit(None)).cast(kind).alias(n)
    return docs.select(col("doc_id", "long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), col("source", "string"), col("lang", "string"), col("n_chars", "long"))


_FEATURES = pa.schema([("at", pa.binary()), *((f"y_{t}", pa.int32()) for t in TARGETS), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("cols", pa.binary()), ("vals", pa.binary())])
_FEATURES_DDL = "at binary, " + ", ".join(f"y_{t} int" for t in TARGETS) + ", source string, lang string, n_chars long, cols binary, vals binary"


def _some(rows: DataFrame, n: int) -> list:
    """About n rows chosen by a hash of their doc_id, exactly the n least of them where there are more: their labels, metadata and text features."""
    total = rows.count()
    span = 1 << 30
    dice = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(span))
    near = rows.withColumn("dice", dice).where(F.col("dice") < min(span, 2 * span * n // max(total, 1) + 1))
    # repeated rows count once; of rows that differ in nothing but metadata the least stays
    near = near.groupBy("dice", "doc_id", F.sha2("text", 256).alias("mark")).agg(F.min(F.struct("text", "source", "lang", "n_chars", *(f"y_{t}" for t in TARGETS))).alias("r"))
    last = near.select(F.struct("dice", "doc_id", "mark").alias("k")).orderBy("k").limit(n).agg(F.max("k").alias("k"))
    picked = near.join(F.broadcast(last), F.struct("dice", "doc_id", "mark") <= F.col("k")).select(F.sha2(F.concat_ws(" ", F.lpad("dice", 10, "0"), "doc_id", "mark"), 256).cast("binary").alias("at"), "r.*")

    def features(batch: pa.RecordBatch) -> dict[str, list]:
        cols, vals, ends = TextView().rows(batch.column("text").to_pylist())
        own = [slice(a, b) for a, b in zip([0, *ends.tolist()], ends.tolist())]
        out = {n: batch.column(n) for n in ("at", *(f"y_{t}" for t in TARGETS), "source", "lang", "n_chars")}
        return out | {"cols": [cols[x].astype(np.int32).tobytes() for x in own], "vals": [vals[x].astype(np.float32).tobytes() for x in own]}

    return sorted(common.map_batches(picked, features, _FEATURES_DDL, _FEATURES).collect(), key=lambda r: bytes(r["at"]))


def _views(rows: list) -> tuple[tuple, tuple]:
    cols = [np.frombuffer(r["cols"], dtype=np.int32) for r in rows]
    vals = [np.frombuffer(r["vals"], dtype=np.float32) for r in rows]
    text = (np.concatenate(cols), np.concatenate(vals), np.cumsum([len(c) for c in cols])) if rows else (np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64))
    return text, MetaView.rows([(r["source"], r["lang"], r["n_chars"]) for r in rows])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    common.prepare(docs.sparkSession)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.min(t).cast("int").alias(f"y_{t}") for t in TARGETS])
    rows = _columns(docs)
    known = _some(rows.join(marks, "doc_id"), labelled)
    unlabelled = rows.join(marks, "doc_id", "left_anti").select("*", *[F.lit(None).cast("int").alias(f"y_{t}") for t in TARGETS])
    views = [_views(known), _views(_some(unlabelled, pool))]
    parts = {}
    for t in TARGETS:
        at = np.array([i for i, r in enumerate(known) if r[f"y_{t}"] is not None], dtype=np.int64)
        y = np.array([float(known[i][f"y_{t}"] > 0) for i in at])
        parts[t] = cotrain(tuple(_take(v, at) for v in views[0]), y, views[1])
    return Model(parts)


_WORKERS: dict[str, Model] = {}


def _warm(model: Model) -> Model:
    if model.key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[model.key] = model
    return _WORKERS[model.key]


_DDL = "doc_id long, quality_score double, toxic_score double, quality int, toxic int, keep boolean"
_TYPES = pa.schema([("doc_id", pa.int64()), ("quality_score", pa.float64()), ("toxic_score", pa.float64()), ("quality", pa.int32()), ("toxic", pa.int32()), ("keep", pa.bool_())])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Every document's calibrated scores, the labels they give at one half, and whether it is kept: good and not toxic."""
    model = model or fit(docs, labels)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        columns = [batch.column(n).to_pylist() for n in ("text", "source", "lang", "n_chars")]
        got = _warm(model).score(columns[0], list(zip(*columns[1:])))
        good, bad = got["quality"], got["toxic"]
        return {"doc_id": batch.column("doc_id"), "quality_score": good, "toxic_score": bad, "quality": (good >= 0.5).astype(np.int32), "toxic": (bad >= 0.5).astype(np.int32), "keep": (good >= 0.5) & (bad < 0.5)}

    return common.map_batches(_columns(docs), run, _DDL, _TYPES)
