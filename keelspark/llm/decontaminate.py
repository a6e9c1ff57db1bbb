"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words (letters and digits) joined by single spaces.  An item of m characters may occur with
k = floor(RATE * m) edits; cut into k + 1 pieces, at least one piece must occur exactly.  One automaton finds all pieces in one pass
over a text; each hit fixes where the item would lie, overlapping windows of an item are merged, and Myers' bit-parallel distance verifies
them.  No pair is lost and only rows with hits leave a task: no shuffle of the texts.

Items of fewer than LEAST characters are searched as whole words: a space before and after belongs to what is compared, so that
"cat" is not found in "concatenate".  Their budget is the same rule, which leaves none below 17 characters.

The items are a query set held against all rows.  Their size is checked: beyond BLOCK_BYTES they are taken in blocks, one pass each, so what
travels to the executors never grows past that.

Defined results: null or empty texts and items match nothing; items that normalise to the same text are reported each; a text that repeats
is reported for each row; a null doc_id is reported as null.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 0.06
#: items of fewer characters are matched as whole words
LEAST = 40
BLOCK_BYTES = 16 << 20
_OTHER = regex.compile(r"[^\p{L}\p{N}\p{M}]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def peq(pattern: str) -> dict[str, int]:
    """Myers' match masks."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, where that substring ends).  Myers' recurrence with one Python
    integer as the bit vector; the least end wins among equals."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
        # the text may begin anywhere, so no carry enters at the bottom
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Matcher:
    """All items of a block, as one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST):
        texts: dict[str, list[int]] = defaultdict(list)
        for i, text in items:
            n = normalise(text)
            if n:
                texts[n].append(i)
        shown = [(n if len(n) >= least else f" {n} ", n, ids) for n, ids in sorted(texts.items())]
        self.items = [(t, sorted(ids), int(rate * len(n)), peq(t)) for t, n, ids in shown]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (t, _, k, _) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[t[a:b]].append((n, a))
        self.tree = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.tree.add_word(piece, (len(piece), where))
        if pieces:
            self.tree.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, edits) of every item within its budget, the fewest edits found."""
        flat = normalise(text)
        if not flat or not self.items:
            return []
        flat = f" {flat} "
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.tree.iter(flat):
            for n, offset in where:
                t, _, k, _ = self.items[n]
                if not k:
                    # the one piece is the whole item
                    windows[n] = []
                    continue
                start = end - size + 1 - offset
                windows[n].append((start - k, start + len(t) + k))
        out = []
        for n, spans in windows.items():
            t, ids, k, masks = self.items[n]
            best = k + 1 if k else 0
            merged: list[list[int]] = []
            for a, b in sorted(set(spans)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                best = min(best, best_match(masks, len(t), flat[max(0, a) : b])[0])
                if not best:
                    break
            if best <= k:
                out += [(i, best) for i in ids]
        return sorted(out)


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(items: tuple, rate: float, least: int) -> Matcher:
    key = (items, rate, least)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(list(items), rate, least)
    return _MATCHERS[key]


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> list[tuple]:
    """The items, in blocks of a checked size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // most) if size else 0
    return [tuple(sorted((r[0], r[1]) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)).collect())) for b in range(n)]


_TYPES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64())])
_DDL = "doc_id long, item_id long, edits long"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, edits: every item that a document holds within the budget, with its fewest edits."""
    spark = docs.sparkSession
    common.prepare(spark)
    out = spark.createDataFrame([], _DDL)
    for items in blocks(benchmark):

        def run(batch: pa.RecordBatch, items=items) -> dict[str, list]:
            m, rows = _matcher(items, rate, least), []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(i, *hit) for hit in m.find(text)]
            return dict(zip(_TYPES.names, map(list, zip(*rows)))) if rows else {n: [] for n in _TYPES.names}

        out = out.union(common.map_batches(common.text_of(docs), run, _DDL, _TYPES))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of docs that hold no item; all columns stay as they are."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index("text")
    for items in blocks(benchmark):

        def run(batches, items=items):
            m = _matcher(items, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not m.find(text) for text in batch.column(at).to_pylist()], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
