"""Expiring caches, single flight, eviction, semantic lookup and run-state machines.

Folds over time are streamed: rows are dealt by key, sorted inside the partition, and one state per key runs along in Arrow batches, so memory does
not grow with a key's history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a
from ..functions.sizes import js_round
from .ordering import global_running_sum
from .vectors import exact, top_k

#: legal steps between run states (fixed values): queued, running, awaiting, succeeded, failed, cancelled
STATES = ("queued", "running", "awaiting_tool", "succeeded", "failed", "cancelled")
LEGAL = {0: (1, 5), 1: (2, 3, 4, 5), 2: (1, 4, 5), 3: (), 4: (), 5: ()}


def remaining(expires: Column, now: Column) -> Column:
    """Seconds left; null without expiry, null once expired."""
    return F.when(expires > now, expires - now)


def live(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def jittered(key: Column, ttl: int, jitter: float = 0.15) -> Column:
    """A time to live spread by at most `jitter`, always the same for a key."""
    spread = 1 + (fnv1a(key) / float(1 << 32) * 2 - 1) * jitter
    return F.greatest(F.lit(1), js_round(F.lit(ttl) * spread)).cast("long")


def single_flight(requests: DataFrame, key: str, at: str, tie: str, compute_us: int, ttl_us: int) -> DataFrame:
    """requests with kind: computed, waited or exact.  at: microseconds.  A miss computes and publishes after compute_us; requests until then wait, those
    within ttl_us after that hit.  The lease is taken as longer than the computation, so no waiter takes over."""
    cols = requests.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"))
    types = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start = object(), None
        for batch in batches:
            kinds = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist()):
                if k != now:
                    now, start = k, None
                if start is None or t >= start + compute_us + ttl_us:
                    start = t
                    kinds.append("computed")
                else:
                    kinds.append("waited" if t < start + compute_us else "exact")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, type=pa.string())], schema=types)

    return cols.repartition("key").sortWithinPartitions("key", "at", "tie").mapInArrow(run, "key string, at long, tie long, kind string")


def backoff_until(waited: int, first: int = 5_000, factor: float = 1.6, most: int = 100_000) -> int:
    """When a waiter that polls with growing pauses, all in microseconds, first looks at or after `waited`."""
    at, pause = 0, first
    while at < waited:
        if pause >= most:
            return at + -(-(waited - at) // most) * most
        at, pause = at + pause, min(most, round(pause * factor))
    return at


def leased_flight(requests: DataFrame, key: str, at: str, tie: str, dies: str, compute_us: int, lease_us: int, ttl_us: int) -> DataFrame:
    """requests with kind, started and wait_us.  A miss takes the lease of a key and computes; a holder that dies publishes nothing, and its lease ends after
    lease_us.  Kinds: computed; waited (for a holder who publishes); takeover (the first to wait for a dead holder, who starts when the lease ends);
    exact (a hit).  started: when the computation that serves the request began; wait_us: until the waiter's poll finds the value or the free lease."""
    cols = requests.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(tie).cast("long").alias("tie"), F.coalesce(F.col(dies), F.lit(False)).alias("dies"))
    types = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("kind", pa.string()), ("started", pa.int64()), ("wait_us", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, dead = object(), None, False
        for batch in batches:
            kinds, starts, waits = [], [], []
            for k, t, d in zip(batch.column("key").to_pylist(), batch.column("at").to_pylist(), batch.column("dies").to_pylist()):
                if k != now:
                    now, start = k, None
                kind, wait = "computed", 0
                if start is not None and dead and t < start + lease_us:
                    kind, start, dead = "takeover", start + lease_us, d
                    wait = backoff_until(start - t)
                elif start is not None and not dead and t < start + compute_us:
                    kind, wait = "waited", backoff_until(start + compute_us - t)
                elif start is not None and not dead and t < start + compute_us + ttl_us:
                    kind = "exact"
                else:
                    start, dead = t, d
                kinds.append(kind)
                starts.append(start)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "at", "tie")), pa.array(kinds, type=pa.string()), pa.array(starts, type=pa.int64()), pa.array(waits, type=pa.int64())], schema=types)

    return cols.repartition("key").sortWithinPartitions("key", "at", "tie").mapInArrow(run, "key string, at long, tie long, kind string, started long, wait_us long")


def fold_states(requests: DataFrame, key: str, target: str, order: list[str]) -> DataFrame:
    """key, status, version, applied, rejected: legal requests move the state and add one to the version, others are rejected."""
    cols = requests.select(F.col(key).cast("long").alias("key"), F.col(target).cast("int").alias("target"), *order)
    types = pa.schema([("key", pa.int64()), ("status", pa.int32()), ("version", pa.int64()), ("applied", pa.int64()), ("rejected", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, version, bad, begun = None, 0, 0, 0, False
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("target").to_pylist()):
                if not begun or k != now:
                    if begun:
                        rows.append((now, state, version, version, bad))
                    now, state, version, bad, begun = k, 0, 0, 0, True
                if t in LEGAL[state]:
                    state, version = t, version + 1
                else:
                    bad += 1
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(types.names, map(list, zip(*rows)))), schema=types)
        if begun:
            yield pa.RecordBatch.from_pydict(dict(zip(types.names, ([x] for x in (now, state, version, version, bad)))), schema=types)

    return cols.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, "key long, status int, version long, applied long, rejected long")


def legality(pairs: DataFrame, current: Column, target: Column) -> Column:
    """Whether a step is legal, as a plain expression."""
    allowed = F.create_map(*[x for s, to in LEGAL.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<int>"))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, current), target), F.lit(False))


def evict(keys: DataFrame, share: float) -> DataFrame:
    """keys with evicted and oom: entries with a time to live go, soonest first, until the rest fits into a share of the total.  Entries without one
    never go.  The running sum is distributed; the totals are one row."""
    totals = keys.agg(F.sum("memory").alias("total"), F.coalesce(F.sum(F.when(F.col("ttl").isNull(), F.col("memory"))), F.lit(0)).alias("durable"))
    goal = totals.select(F.floor(F.col("total") * share).alias("budget"), "total", "durable")
    volatile = global_running_sum(keys.where("ttl is not null"), "memory", "ttl", ["key"], "upto").crossJoin(F.broadcast(goal))
    gone = volatile.withColumn("evicted", F.col("total") - (F.col("upto") - F.col("memory")) > F.col("budget"))
    rest = keys.where("ttl is null").crossJoin(F.broadcast(goal)).withColumn("evicted", F.lit(False))
    cols = ["key", "memory", "ttl", "evicted", (F.col("durable") > F.col("budget")).alias("oom")]
    return gone.select(cols).unionByName(rest.select(cols))


def semantic_lookup(cached: DataFrame, requests: DataFrame, threshold: float) -> DataFrame:
    """id, key, score, kind: the nearest cached vector of each request, a hit from the threshold upwards."""
    best = top_k(cached, requests, exact, 1)
    return best.select(F.col("q_id").alias("id"), F.col("id").alias("key"), "score", F.when(F.col("score") >= threshold, "semantic").otherwise("miss").alias("kind"))
