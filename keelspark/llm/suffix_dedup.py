"""Repeated strings by a distributed difference-cover suffix comparison.

A text is a sequence of units: its UTF-8 bytes, or its words.  What is asked of the sorted suffixes is only whether a neighbour shares their
first `length` units, so the difference-cover algorithm is run with a large period and stops at that depth:

1. Sample.  Positions whose residue modulo v lies in a difference cover D of v are sampled (bytes: v = 307, |D| = 18, 5.9 % of all positions;
   words: v = 31, |D| = 6).  For any two positions i, j there is a shift d < v with i + d and j + d both sampled, so two suffixes that share
   `length` units share the name of a sampled (length - v + 1)-tuple at an equal shift.
2. Sort the sampled tuples and name them: the tuples' fingerprints are dealt out by range and sorted, equal ones share a name.
   Unique names are dropped, their suffixes have no neighbour that matters; this is the usual discarding step of the recursion.
3. Merge the remaining suffixes: those that lead to a surviving sample within v units get the name of their prefix of the whole length, by the
   same distributed sort.
4. Compare adjacent prefixes: an equal neighbour marks the string as repeated.
5. Confirm: the marked strings alone are named once more by other polynomials and sorted again; only those that meet an equal again count.

A third level of names is not needed because the depth is bounded.  Names are 62-bit fingerprints (two polynomials modulo 2^31 - 1, whose bases
are drawn from the table's own content, so that no text can be written to collide), packed as sorted, difference-coded arrays, so a shuffled row
is a block of some hundred names, not one suffix.  Answers come back as one bit per name.  Texts too short to hold such a string are left out;
equal texts are compared once, with a count.

No group is hot: a chunk of texts sends each name once, whatever the number of copies.  A chunk is CHUNK_BYTES of text, dealt by a hash of the
text, and a sorting task takes about PER_TASK names; both follow from the counted bytes alone, not from the number of partitions, and grow with
the square root of a very large table, so that a block keeps a hundred names.  A Python worker's memory is bounded by a chunk or by its longest text.

`op9` cuts 400-byte strings that start anywhere else.  `remove_repeats` cuts passages: runs of more than 50 words that a different text holds too.
Copies of a whole text are no passage of it: which of them stays is another stage's matter, and cutting would leave none.

Defined results: null is the empty text; empty and short texts keep all bytes; every copy of a repeated string goes, as the contract
says; rows with equal texts get equal values; a null doc_id is kept as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH, ORDER = 400, 17
#: passages of over 50 words
WORDS, WORD_ORDER = 51, 5
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525)
SEGMENT = 1 << 19
#: names that one sorting task gets, about
PER_TASK = 500_000
#: text of a chunk
CHUNK_BYTES = 5 << 20
#: names that a block of a chunk's names for one sorting task holds at least, on average
BLOCK_NAMES = 100
#: longer words are hashed one by one
_LONG = 1 << 12
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def difference_cover(q: int) -> tuple[int, list[int]]:
    """Singer's perfect difference set for a prime q: v = q*q + q + 1 and q + 1 residues whose differences are all of Z_v.
    They are the powers of a generator of GF(q^3) that fall into a plane."""
    v = q * q + q + 1
    for c in range(1, q):
        for b in range(q):
            # x^3 = b x + c; the powers of x modulo scalars must run through all v points
            point, seen, found = (1, 0, 0), set(), []
            for i in range(v):
                lead = next(x for x in point if x)
                inverse = pow(lead, -1, q)
                mark = tuple(x * inverse % q for x in point)
                if mark in seen:
                    break
                seen.add(mark)
                if point[2] == 0:
                    found.append(i)
                point = (point[2] * c % q, (point[0] + point[2] * b) % q, point[1])
            if len(seen) == v and len({(x - y) % v for x in found for y in found}) == v:
                return v, found
    raise ValueError(f"no difference set found for {q}")


@lru_cache(16)
def _powers(base: int, n: int) -> np.ndarray:
    """1, B, B^2, ... modulo PRIME, n of them."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


@lru_cache(8)
def _cover(q: int) -> tuple[int, np.ndarray]:
    v, residues = difference_cover(q)
    inside = np.zeros(v, dtype=bool)
    inside[residues] = True
    return v, inside


def bases_from(seed: int, turn: int = 0) -> tuple[int, int]:
    """Two bases that follow from the content of a table, others for each turn."""
    raw = hashlib.sha256(f"{seed}/{turn}".encode()).digest()
    return tuple((1 << 20) + int.from_bytes(raw[k : k + 8], "little") % (PRIME - (1 << 21)) for k in (0, 8))


def fingerprints(values: tuple[np.ndarray, np.ndarray], width: int | np.ndarray, at: np.ndarray, bases: tuple[int, int] = BASES) -> np.ndarray:
    """62-bit fingerprints of the units [i : i + width) for the ascending positions i in `at`; values: the units as each polynomial reads
    them, below PRIME; width: one for all, or one of up to _LONG for each position."""
    out = np.empty(len(at), dtype=np.uint64)
    if not len(at):
        return out
    each = isinstance(width, np.ndarray)
    # the same for all chunks: prints are scaled by it
    reach = _LONG if each else width
    top, p = SEGMENT + reach, np.uint64(PRIME)
    cuts = np.searchsorted(at, np.arange(0, len(values[0]) + SEGMENT, SEGMENT))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        begin = k * SEGMENT
        here = at[a:b] - begin
        there = here + (width[a:b] if each else width)
        both = []
        for base, units in zip(bases, values):
            power = _powers(base, top + 1)
            seg = (units[begin : begin + top].astype(np.uint64) + np.uint64(1)) * power[: min(top, len(units) - begin)]
            if units.dtype.itemsize > 1:
                seg %= p
            run = np.zeros(len(seg) + 1, dtype=np.uint64)
            np.cumsum(seg, out=run[1:])
            both.append((run[there] - run[here]) % p * power[top - here] % p)
        out[a:b] = both[0] << np.uint64(31) | both[1]
    return out


def word_units(buf: np.ndarray, bases: tuple[int, int]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The words of buf: what each polynomial reads for them, where each starts and stops."""
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    prints = fingerprints((buf, buf), np.minimum(stop - start, _LONG), start, bases)
    for i in np.flatnonzero(stop - start > _LONG).tolist():
        prints[i] = xxhash.xxh64_intdigest(buf[start[i] : stop[i]].tobytes(), 9) >> 2
    p = np.uint64(PRIME)
    # a unit must stay below PRIME after one is added
    return tuple((x % (p - np.uint64(1))).astype(np.uint32) for x in (prints >> np.uint64(31), prints & p)), start, stop


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences of just enough bytes."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values[:1] * 0)
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(values) > 1 else 1
    return bytes([width]) + values[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width = blob[0]
    tail = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(tail) + 1, 8), dtype=np.uint8)
    steps[1:, :width] = tail
    steps = steps.reshape(-1).view(np.uint64)
    steps[0] = np.frombuffer(blob, dtype=np.uint64, count=1, offset=1)[0]
    return np.cumsum(steps, dtype=np.uint64)


class Plan(NamedTuple):
    """What counts as a repeated string, and how it is looked for.  words: units are words; apart: only strings that two different texts hold count;
    chars: runs are widened to whole characters."""

    length: int = LENGTH
    q: int = ORDER
    words: bool = False
    apart: bool = False
    chars: bool = False
    per_task: int = PER_TASK
    chunk_bytes: int = CHUNK_BYTES
    bases: tuple[int, int] = BASES
    again: tuple[int, int] = BASES[::-1]


BYTES = Plan()
PASSAGES = Plan(WORDS, WORD_ORDER, words=True, apart=True)


class Chunk:
    """Some texts, in an order that depends on the texts alone, as one sequence of units."""

    def __init__(self, texts: list[bytes], counts: list[int], plan: Plan):
        order = sorted(range(len(texts)), key=texts.__getitem__)
        self.texts = [texts[i] for i in order]
        self.many = np.array([counts[i] > 1 for i in order], dtype=bool)
        self.plan, self.length, (self.period, self.inside) = plan, plan.length, _cover(plan.q)
        size = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(texts))
        if plan.words:
            buf = np.frombuffer(b" ".join(self.texts), dtype=np.uint8)
            self.begin = np.cumsum(size + 1) - size - 1
            self.values, self.word_start, self.word_stop = word_units(buf, plan.bases)
            self.stop = np.searchsorted(self.word_start, self.begin + size)
            self.start = np.searchsorted(self.word_start, self.begin)
        else:
            buf = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
            self.values = (buf, buf)
            self.stop = np.cumsum(size)
            self.start = self.stop - size
        self.n = len(self.values[0])

    def _owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.stop, at, side="right")

    def prints(self, width: int, at: np.ndarray, again: bool = False) -> np.ndarray:
        return fingerprints(self.values, width, at, self.plan.again if again else self.plan.bases)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions whose tuple lies inside their text, and the tuples' fingerprints."""
        width = self.length - self.period + 1
        found = []
        for s, e in zip(self.start.tolist(), self.stop.tolist()):
            n = e - s
            if n >= self.length:
                whole = np.flatnonzero(self.inside)[None, :] + self.period * np.arange((n - width) // self.period + 1)[:, None]
                whole = whole.reshape(-1)
                found.append(whole[whole <= n - width] + s)
        at = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return at, self.prints(width, at)

    def candidates(self, at: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Starts within a period before a surviving sample, at which a whole string fits into the text."""
        at = at[alive]
        own = self._owner(at)
        lo, hi = np.maximum(at - self.period + 1, self.start[own]), np.minimum(at, self.stop[own] - self.length) + 1
        fits = hi > lo
        return _union(lo[fits], hi[fits], self.n)

    def names(self, at: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct names with a low bit that says whether this chunk has it more than once; each position's place among them."""
        distinct, place, times = np.unique(prints, return_inverse=True, return_counts=True)
        many = times > 1
        if self.plan.apart:
            own, one = self._owner(at), np.empty(len(distinct), dtype=np.int64)
            # one of the texts that hold a name; any other that does makes it repeated
            one[place] = own
            many = np.zeros(len(distinct), dtype=bool)
            many[place[own != one[place]]] = True
        elif self.many.any() and len(at):
            many[place[self.many[self._owner(at)]]] = True
        return distinct << np.uint64(1) | many.astype(np.uint64), place

    def covered(self, starts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
        """For each text that has any: the maximal runs of bytes that the strings at these starts cover."""
        if not len(starts):
            return []
        own = self._owner(starts)
        cut = np.flatnonzero((starts[1:] > starts[:-1] + self.length) | (own[1:] != own[:-1])) + 1
        lo, hi = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + self.length
        own = own[np.append(0, cut)]
        if self.plan.words:
            lo, hi = self.word_start[lo] - self.begin[own], self.word_stop[hi - 1] - self.begin[own]
        else:
            lo, hi = lo - self.start[own], hi - self.start[own]
        out: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(own.tolist(), lo.tolist(), hi.tolist()):
            if self.plan.chars:
                raw = self.texts[i]
                while raw[a] & 0xC0 == 0x80:
                    a -= 1
                while b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b += 1
            out.setdefault(i, []).append((a, b))
        return list(out.items())


def _union(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Positions inside any of the intervals [lo, hi)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
_ASK_DDL = "bucket long, chunk long, n long, blob binary"


def _deal(names: np.ndarray, chunk: int, buckets: int) -> dict[str, list]:
    """names, cut by range into blocks for the sorting tasks."""
    high = (names >> np.uint64(32)).astype(np.int64) * buckets >> 31
    used, first = np.unique(high, return_index=True)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(names)]))
    return {"bucket": used.tolist(), "chunk": [chunk] * len(used), "n": [b - a for a, b in cuts], "blob": [pack(names[a:b]) for a, b in cuts]}


def _sort_names(rows: pa.Table) -> pa.Table:
    """One range of names from all chunks: a bit for each, whether an equal neighbour exists.  Negative buckets hold no names and pass."""
    if rows.column("bucket")[0].as_py() < 0:
        return rows
    chunks, parts = rows.column("chunk").to_pylist(), [unpack(b) for b in rows.column("blob").to_pylist()]
    bucket = rows.column("bucket")[0].as_py()
    every = np.concatenate(parts)
    plain = np.sort(every >> np.uint64(1))
    twice = np.unique(plain[1:][plain[1:] == plain[:-1]])
    own = np.unique(every[(every & np.uint64(1)) == 1] >> np.uint64(1))
    known = np.union1d(twice, own)
    bits = []
    for part in parts:
        key = part >> np.uint64(1)
        place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        bits.append(np.packbits(known[place] == key).tobytes() if len(known) else bytes(-(-len(key) // 8)))
    return pa.Table.from_pydict({"bucket": [bucket] * len(parts), "chunk": chunks, "n": rows.column("n").to_pylist(), "blob": bits}, schema=_ASK)


def _answers(rows: pa.Table) -> np.ndarray:
    """A chunk's bits in the order of its names."""
    got = sorted((b, n, blob) for b, n, blob in zip(rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), rows.column("blob").to_pylist()) if b >= 0)
    return np.concatenate([np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n) for _, n, blob in got]).astype(bool) if got else np.zeros(0, dtype=bool)


def _chunk(rows: pa.Table, plan: Plan) -> Chunk:
    return Chunk(common.utf8(rows.column("text").combine_chunks()) if rows.num_rows else [], rows.column("copies").to_pylist(), plan)


def distinct_texts(docs: DataFrame, least: int) -> DataFrame:
    """text, copies: the different texts of at least so many bytes, in the shared folder."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= least).groupBy("text").agg(F.count("*").alias("copies"))
    return common.staged(texts, "suffix-texts")


_SPANS = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])
_SPANS_DDL = "key binary, n_removed long, spans array<struct<start: long, stop: long>>, kept_sha256 string"


def repeated_spans(texts: DataFrame, plan: Plan = BYTES) -> DataFrame:
    """texts: as distinct_texts gives them.  Returns key (SHA-256 of the text), spans (start, stop of each maximal repeated run, in bytes), n_removed and
    the kept bytes' digest, one row for each distinct text that loses bytes."""
    total, seed = texts.agg(F.sum(F.octet_length("text")), F.bit_xor(F.xxhash64("text"))).first()
    total = total or 0
    # the product of a chunk's share and a task's share of all names must leave BLOCK_NAMES to a block
    grown = isqrt(BLOCK_NAMES * total)
    chunks = -(-total // max(plan.chunk_bytes, 2 * grown)) or 1
    plan = plan._replace(bases=bases_from(seed or 0), again=bases_from(seed or 0, 1))
    period, inside = _cover(plan.q)
    units = total // 6 if plan.words else total
    held = texts.withColumn("chunk", F.pmod(F.xxhash64("text"), F.lit(chunks)))

    def tasks(names: float) -> int:
        # no more than blocks can fill, and a few tasks for a small table too
        return max(1, int(max(names / max(plan.per_task, grown / 2), min(32, names / 20_000))))

    # sort the sampled tuples, name them, drop unique names
    sample_buckets = tasks(units * inside.sum() / period)

    def ask_samples(rows: pa.Table) -> pa.Table:
        c = _chunk(rows, plan)
        names, _ = c.names(*c.samples())
        return pa.Table.from_pydict(_deal(names, rows.column("chunk")[0].as_py(), sample_buckets), schema=_ASK)

    asked = held.groupBy("chunk").applyInArrow(ask_samples, _ASK_DDL)
    alive = common.staged(asked.groupBy("bucket").applyInArrow(_sort_names, _ASK_DDL), "suffix-alive")

    # merge the remaining suffixes: name their prefixes of the whole length
    prefix_buckets = tasks(units / 4)

    def asked_of(c: Chunk, chunk: int, starts: np.ndarray, again: bool) -> pa.Table:
        """The names of the strings at these starts for the sorting tasks, and the starts as runs, which pass along in a group of their own."""
        names, _ = c.names(starts, c.prints(plan.length, starts, again))
        out = _deal(names, chunk, prefix_buckets)
        cut = np.flatnonzero(np.diff(starts) > 1) + 1
        runs = np.stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + 1], 1).reshape(-1) if len(starts) else starts
        for name, value in zip(_ASK.names, (-1 - chunk, chunk, len(runs), pack(runs.astype(np.uint64)))):
            out[name] = [*out[name], value]
        return pa.Table.from_pydict(out, schema=_ASK)

    def repeated(c: Chunk, told: pa.Table, again: bool) -> np.ndarray:
        """The starts that were asked for and have an equal."""
        own = [blob for b, blob in zip(told.column("bucket").to_pylist(), told.column("blob").to_pylist()) if b < 0]
        edges = unpack(own[0]).astype(np.int64) if own else np.zeros(0, dtype=np.int64)
        starts = _union(edges[::2], edges[1::2], c.n)
        _, place = c.names(starts, c.prints(plan.length, starts, again))
        return starts[_answers(told)[place]]

    def none() -> pa.Table:
        return pa.Table.from_pydict({n: [] for n in _ASK.names}, schema=_ASK)

    def ask_prefixes(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return none()
        c = _chunk(rows, plan)
        at, prints = c.samples()
        _, place = c.names(at, prints)
        return asked_of(c, rows.column("chunk")[0].as_py(), c.candidates(at, _answers(told)[place]), False)

    def ask_again(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return none()
        c = _chunk(rows, plan)
        return asked_of(c, rows.column("chunk")[0].as_py(), repeated(c, told, False), True)

    def cogrouped(other: DataFrame, fn, ddl: str) -> DataFrame:
        return held.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(fn, ddl)

    def sorted_names(asked: DataFrame, label: str) -> DataFrame:
        return common.staged(asked.groupBy("bucket").applyInArrow(_sort_names, _ASK_DDL), label)

    # compare adjacent prefixes, then confirm what has an equal
    verdict = sorted_names(cogrouped(alive, ask_prefixes, _ASK_DDL), "suffix-verdict")
    common.discard(alive)
    sure = sorted_names(cogrouped(verdict, ask_again, _ASK_DDL), "suffix-sure")
    common.discard(verdict)

    def settle(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {n: [] for n in _SPANS.names}
        if rows.num_rows:
            c = _chunk(rows, plan)
            for i, spans in c.covered(repeated(c, told, True)):
                out["key"].append(hashlib.sha256(c.texts[i]).digest())
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
                out["kept_sha256"].append(hashlib.sha256(kept(c.texts[i], spans)).hexdigest())
        return pa.Table.from_pydict(out, schema=_SPANS)

    spans = common.staged(cogrouped(sure, settle, _SPANS_DDL), "suffix-spans")
    common.discard(sure)
    return spans


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without its spans."""
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def op9(docs: DataFrame, plan: Plan = BYTES, passages: Plan = PASSAGES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document under `plan`; n_passages: its maximal runs of more than 50 words that
    a document with another text holds too."""
    common.prepare(docs.sparkSession)
    texts = distinct_texts(docs, min(plan.length, 2 * passages.length - 1))
    runs = repeated_spans(texts, passages).select(F.hex("key").alias("key"), F.size("spans").cast("long").alias("n_passages"))
    spans = repeated_spans(texts, plan).select(F.hex("key").alias("key"), "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    common.discard(texts)
    told = spans.join(runs, "key", "full")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    none = F.lit(0).cast("long")
    rows = rows.withColumn("key", F.upper("own")).join(told, "key", "left")
    return rows.select("doc_id", "n_bytes", *[F.coalesce(c, none).alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept_sha256", "own").alias("kept_sha256"), F.coalesce("n_passages", none).alias("n_passages"))


def remove_repeats(docs: DataFrame, plan: Plan = PASSAGES) -> DataFrame:
    """docs with the repeated strings of text cut out, all copies of them; a character cut in two at a run's edge goes whole.  Other columns stay,
    whatever their names; null texts stay null."""
    common.prepare(docs.sparkSession)
    texts = distinct_texts(docs, 2 * plan.length - 1 if plan.words else plan.length)
    spans = repeated_spans(texts, plan._replace(chars=True)).select(F.hex("key").alias("key"), "spans")
    common.discard(texts)
    text = F.col("row.text").cast("string")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = held.withColumn("key", F.upper(F.sha2(F.coalesce(text, F.lit("")), 256))).join(spans, "key", "left")
    raw = F.encode(text, "UTF-8")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["stop"]))), F.array(F.octet_length(text).cast("long")))
    pieces = F.transform(F.sequence(F.lit(0), F.size(edges) - 1, F.lit(2)), lambda i: F.substring(raw, (F.get(edges, i) + 1).cast("int"), (F.get(edges, i + 1) - F.get(edges, i)).cast("int")))
    whole = F.concat_ws("", F.transform(pieces, lambda p: p.cast("string")))
    cut = F.when(F.col("spans").isNull(), text).otherwise(whole)
    return joined.select(*[(cut if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
