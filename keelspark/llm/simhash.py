"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints (64 bits, four-word shingles) are made row by row.  Two fingerprints that differ in at most four bits agree on one of five
bit blocks, so the distinct fingerprints are dealt out five times, once by each block.  A task turns its fingerprints into one binary
trie per block value and walks node pairs together from the roots: the differing bits of a pair add up, a pair over the budget is
pruned, a pair that can no longer exceed it links both subtrees at once, and pairs whose subtrees already hang together are dropped.
Only a spanning forest leaves the task, never all pairs.  A block value with very many fingerprints is dealt again by five sub-blocks
of its remaining bits, which loses no pair.  Components are joined over the whole table afterwards.

Defined results: null or wordless texts have fingerprint zero, linked like any other; repeated doc_ids keep a row each; a null doc_id is
fingerprinted and linked, and counts as no member when the least id is taken; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, BUDGET, BLOCKS, SHINGLE = 64, 4, 5, 4
#: a block value with more fingerprints than this is dealt again by sub-blocks
HOT = 100_000
#: fingerprints (times five) that one trie task gets, about
PER_TASK = 60_000
_BIT = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)[None, :]) & 1).astype(np.int64)
_SPAN = 1 << 15


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer."""
    words = raw.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - width + 1)
    stop = (start + size)[min(width, len(words)) - 1 :]
    seen = np.zeros((8, 256), dtype=np.int64)
    make = xxhash.xxh64_digest
    for k in range(0, n, _SPAN):
        part = b"".join([make(flat[a:b], 42) for a, b in zip(start[k : min(n, k + _SPAN)].tolist(), stop[k : k + _SPAN].tolist())])
        digests = np.frombuffer(part, dtype=np.uint8).reshape(-1, 8)
        for j in range(8):
            seen[j] += np.bincount(digests[:, j], minlength=256)
    return int.from_bytes(np.packbits((2 * (seen @ _BIT) > n).reshape(-1)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""
    common.prepare(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        made = np.array([fingerprint(raw, width) for raw in common.utf8(batch.column("text"))], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": made.view(np.int64)}

    return common.map_batches(common.text_of(docs), run, "doc_id long, fp long", arrow)


class Forest:
    """Union-find over array positions, with whole-array operations."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return self.up
            self.up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            keep = x != y
            if not keep.any():
                return
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(x, y)[keep], np.minimum(x, y)[keep])


def trie_links(group: np.ndarray, value: np.ndarray, top: int = 0, budget: int = BUDGET, most: int = 200_000) -> Forest:
    """group, value: sorted by (group, value), values distinct within a group.  One binary trie per group, its root below the first `top`
    bits (equal for all values of the group).  Returns the forest that links all values of a group within the budget."""
    n = len(value)
    forest = Forest(n)
    if not n:
        return forest
    value = value.astype(np.uint64)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    end = np.append(begin[1:], n)
    big = end - begin > 1
    lo, hi = begin[big], end[big]
    # a frontier entry: node a = [a0, a1), node b = [b0, b1), differing bits so far; all entries of a slice are at one depth
    stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > most:
            for k in range(0, len(a0), most):
                stack.append((depth, *(x[k : k + most] for x in (a0, a1, b0, b1, diff))))
            continue
        r = forest.roots()
        # subtrees that already hang together need no further look
        if len(a0) > 64:
            same = r[a0] == r[b0]
            for lo_, hi_ in ((a0, a1), (b0, b1)):
                wide = same & (hi_ - lo_ > 1)
                if wide.any():
                    at = np.flatnonzero(wide)
                    edge = np.stack([lo_[at], hi_[at]], 1).reshape(-1)
                    r1 = np.append(r, r[-1])
                    same[at] &= np.minimum.reduceat(r1, edge)[::2] == np.maximum.reduceat(r1, edge)[::2]
            keep = ~(same & ~((a0 == b0) & (a1 - a0 == 1)))
            a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
        # no bits left that could exceed the budget: both subtrees are one component
        sure = diff + (BITS - depth) <= budget
        if sure.any():
            _join_ranges(forest, a0[sure], a1[sure], b0[sure], b1[sure])
            a0, a1, b0, b1, diff = (x[~sure] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        bit = np.uint64(BITS - 1 - depth)
        am, bm = _middle(value, bit, a0, a1), _middle(value, bit, b0, b1)
        twin = (a0 == b0) & (a1 == b1)
        out = []
        for (x0, x1), (y0, y1), more, skip in (((a0, am), (b0, bm), 0, None), ((am, a1), (bm, b1), 0, None), ((a0, am), (bm, b1), 1, None), ((am, a1), (b0, bm), 1, twin)):
            d = diff + more
            keep = (x1 > x0) & (y1 > y0) & (d <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            if skip is not None:
                keep &= ~skip
            out.append((x0[keep], x1[keep], y0[keep], y1[keep], d[keep]))
        nxt = tuple(np.concatenate(x) for x in zip(*out))
        if len(nxt[0]):
            stack.append((depth + 1, *nxt))
    return forest


def _middle(value: np.ndarray, bit: np.uint64, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where a node's ones begin: the first position in [lo, hi) whose value has the bit set."""
    a, b = lo.copy(), hi.copy()
    while True:
        open_ = a < b
        if not open_.any():
            return a
        mid = (a + b) // 2
        one = ((value[np.minimum(mid, len(value) - 1)] >> bit) & np.uint64(1)).astype(bool)
        b = np.where(open_ & one, mid, b)
        a = np.where(open_ & ~one, mid + 1, a)


def _join_ranges(forest: Forest, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
    forest.link(a0, b0)
    for lo, hi in ((a0, a1), (b0, b1)):
        wide = hi - lo > 1
        if wide.any():
            count = (hi - lo)[wide] - 1
            first = np.repeat(lo[wide], count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
            forest.link(first, first + step)


def _spans(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    cuts = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def _bits(lo: int, hi: int):
    """Bits lo to hi, counted from the top, of the column fp."""
    return F.shiftrightunsigned("fp", BITS - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _task(rows: pa.Table) -> pa.Table:
    """All groups of one deal: the links of each, as a star forest."""
    fp = rows.column("fp").to_numpy().view(np.uint64)
    turn = rows.column("turn").to_numpy().astype(np.uint64)
    key = rows.column("key").to_numpy()
    # the agreed block goes to the top, where the trie's root is
    turned = np.where(turn == 0, fp, (fp << turn) | (fp >> ((np.uint64(64) - turn) & np.uint64(63))))
    order = np.lexsort((turned, key))
    fp, turned, key = fp[order], turned[order], key[order]
    roots = trie_links(key, turned).roots()
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return pa.Table.from_pydict({"u": fp[linked].view(np.int64), "v": fp[roots[linked]].view(np.int64)}, schema=_EDGES)


def links(distinct: DataFrame, hot: int = HOT, per_task: int = PER_TASK) -> DataFrame:
    """distinct: fp.  Returns u, v: edges whose components are those of all pairs within the budget."""
    n = distinct.count()
    blocks = _spans(0, BITS, BLOCKS)
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _bits(lo, hi).alias("value"), F.lit(lo).alias("turn")) for k, (lo, hi) in enumerate(blocks)])).alias("b")).select("fp", "b.block", "b.value", "b.turn")
    common_ = F.xxhash64(*[F.col(c) for c in ("block", "value")])
    if n > hot:
        counts = dealt.groupBy("block", "value").count().where(F.col("count") > hot).select("block", "value", F.lit(True).alias("hot"))
        marked = dealt.join(counts, ["block", "value"], "left")
        subs = []
        for k, (lo, hi) in enumerate(blocks):
            # the 51 or 52 bits outside the block, cut in five; a part may run around the end
            rest = [(hi + i) % BITS for i in range(BITS - (hi - lo))]
            for j, (s, e) in enumerate(_spans(0, len(rest), BLOCKS)):
                at = rest[s:e]
                runs = [(at[0], at[-1] + 1)] if at[-1] >= at[0] else [(at[0], BITS), (0, at[-1] + 1)]
                subs.append((k, F.struct(F.lit(j).alias("sub"), F.xxhash64(*[_bits(a, b) for a, b in runs]).alias("sub_value"))))
        pick = [F.when(F.col("block") == k, F.array(*[s for kk, s in subs if kk == k])) for k in range(BLOCKS)]
        plain = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("sub_value")))
        dealt = marked.select("fp", "block", "value", "turn", F.explode(F.when(F.col("hot"), F.coalesce(*pick)).otherwise(plain)).alias("s")).select("fp", "block", "value", "turn", "s.sub", "s.sub_value")
        common_ = F.xxhash64("block", "value", "sub", "sub_value")
    tasks = max(1, -(-n * BLOCKS // per_task))
    keyed = dealt.select("fp", "turn", common_.alias("key")).withColumn("deal", F.pmod(F.col("key"), F.lit(tasks)))
    return keyed.groupBy("deal").applyInArrow(_task, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links of at most four differing bits."""
    marks = common.staged(fingerprints(docs, width), "simhash")
    least = common.staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "simhash-fp")
    roots = common.staged(components(links(least.select("fp"))), "simhash-cc")
    classes = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "times", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = common.staged(classes.join(ids, "root").select("fp", "times", "component_id"), "simhash-named")
    return common.lookup(marks, named, "fp").select("doc_id", "fp", "component_id")


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; rows without doc_id stay; of repeated doc_ids every row stays."""
    groups = near_duplicates(docs)
    go = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti")


def pairs_within(fps: list[int], budget: int = BUDGET) -> Iterator[tuple[int, int]]:
    """Brute force, for tests."""
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget:
                yield a, b
