"""Stores over DataFrames.  A store is a value: what changes it gives a new one, what reads it gives a DataFrame, and Catalyst plans the whole.

Writes carry a number of their own, so the last write of a key wins whatever the order of rows.  Long chains of writes should be written out (`saved`)
now and then, which ends their lineage.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.hashing import fnv1a
from ..sources.shared import saved
from . import buckets, seen, state
from . import vectors as search


@dataclass(frozen=True)
class Pouch:
    """id -> value in hashed shards.  rows: id string, value, seq long."""

    rows: DataFrame
    capacity: int
    width: int = 124
    prefix: str = "p"
    grown: int = 0

    @property
    def shards(self) -> int:
        return 2 ** (max(0, math.ceil(math.log2(max(1, math.ceil(self.capacity / self.width))))) + self.grown)

    def key_for(self, id_: Column) -> Column:
        return F.concat(F.lit(f"{self.prefix}:{{"), F.pmod(fnv1a(id_), F.lit(self.shards)), F.lit("}"))

    def prev_key_for(self, id_: Column) -> Column:
        """The old home of an id after a split; null where it has not moved."""
        h = fnv1a(id_)
        old, new = F.pmod(h, F.lit(self.shards // 2)), F.pmod(h, F.lit(self.shards))
        return F.when(old != new, F.concat(F.lit(f"{self.prefix}:{{"), old, F.lit("}")))

    def set(self, rows: DataFrame, seq: int) -> Pouch:
        """rows: id, value."""
        every = self.rows.unionByName(rows.select("id", "value", F.lit(seq).cast("long").alias("seq")))
        return replace(self, rows=buckets.upsert(every, ["id"], ["seq"]))

    def get(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.rows.select("id", "value"), "id", "left")

    def mget(self, requests: DataFrame) -> DataFrame:
        return buckets.mget(requests, self.rows.select("id", "value"))

    def has(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.rows.select("id", F.lit(True).alias("has")), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has"))

    def delete(self, ids: DataFrame) -> Pouch:
        return replace(self, rows=buckets.delete(self.rows, ids, "id"))

    def count(self) -> DataFrame:
        return self.rows.groupBy(self.key_for(F.col("id")).alias("shard")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def split(self) -> tuple[Pouch, DataFrame]:
        """The store with twice the shards, and what moves from each old one."""
        k = int(math.log2(self.shards))
        return replace(self, grown=self.grown + 1), buckets.moves(self.rows, F.col("id"), k)

    def grow_to(self, shards: int, on_progress: Callable[[dict], None] | None = None) -> Pouch:
        """As many splits as it takes; on_progress hears of each: from, to, moved, scanned."""
        store = self
        while store.shards < shards:
            before = store.shards
            store, moves = store.split()
            if on_progress:
                told = moves.agg(F.coalesce(F.sum("moved"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
                on_progress({"from": before, "to": store.shards, "moved": told[0], "scanned": told[1]})
        return store

    def saved(self) -> Pouch:
        return replace(self, rows=saved(self.rows, "pouch"))


@dataclass(frozen=True)
class ShardedCache:
    """key -> value with a time to live each.  rows: key, value, expires (seconds, null: never), seq."""

    rows: DataFrame
    ttl: int = 3600

    def set(self, rows: DataFrame, now: int, seq: int, ttl: int | None = None) -> ShardedCache:
        fresh = rows.select("key", "value", F.lit(now + (ttl or self.ttl)).cast("long").alias("expires"), F.lit(seq).cast("long").alias("seq"))
        return replace(self, rows=buckets.upsert(self.rows.unionByName(fresh), ["key"], ["seq"]))

    def live(self, now: int) -> DataFrame:
        return state.live(self.rows, "expires", F.lit(now))

    def get(self, keys: DataFrame, now: int) -> DataFrame:
        return keys.select("key").join(self.live(now).select("key", "value"), "key", "left")

    def ttl_of(self, keys: DataFrame, now: int) -> DataFrame:
        return keys.select("key").join(self.rows.select("key", state.remaining(F.col("expires"), F.lit(now)).alias("seconds")), "key", "left")

    def delete(self, keys: DataFrame) -> ShardedCache:
        return replace(self, rows=buckets.delete(self.rows, keys, "key"))

    def persist(self, keys: DataFrame) -> ShardedCache:
        kept = self.rows.join(keys.select("key", F.lit(True).alias("__keep")), "key", "left")
        return replace(self, rows=kept.withColumn("expires", F.when(F.col("__keep").isNull(), F.col("expires"))).drop("__keep"))


@dataclass(frozen=True)
class ExactSeen:
    """A set of ids.  rows: id."""

    rows: DataFrame

    def add(self, ids: DataFrame, order: list[str]) -> tuple[ExactSeen, DataFrame]:
        """The larger set, and ids with added: true for the first time an id is seen at all."""
        told = seen.first_seen(ids, ["id"], order).join(self.rows.select("id", F.lit(True).alias("__old")), "id", "left")
        told = told.withColumn("added", F.col("added") & F.col("__old").isNull()).drop("__old")
        return replace(self, rows=self.rows.unionByName(ids.select("id")).distinct()), told

    def has(self, ids: DataFrame) -> DataFrame:
        return ids.select("id").join(self.rows.select("id", F.lit(True).alias("has")), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has"))

    def remove(self, ids: DataFrame) -> ExactSeen:
        return replace(self, rows=buckets.delete(self.rows, ids, "id"))

    def count(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class BloomSeen:
    """A Bloom filter of a fixed size.  bits: bucket, bits."""

    bits: DataFrame | None
    capacity: int
    error: float = 0.01

    @property
    def size(self) -> tuple[int, int]:
        return seen.bloom_size(self.capacity, self.error)

    def add(self, ids: DataFrame) -> BloomSeen:
        made = seen.bloom(ids.select("id"), "id", *self.size)
        if self.bits is None:
            return replace(self, bits=made)
        return replace(self, bits=self.bits.unionByName(made).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    def has(self, ids: DataFrame) -> DataFrame:
        """maybe: false is certain."""
        return seen.bloom_probe(ids.select("id"), "id", self.bits, *self.size)


@dataclass(frozen=True)
class VectorMemory:
    """id -> vector with attributes.  rows: vec_id, embedding, seq and any attribute columns."""

    rows: DataFrame
    dim: int
    quant: str = "int8"

    def add(self, rows: DataFrame, seq: int) -> VectorMemory:
        """Vectors of another dimension raise when the plan runs."""
        right = F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors have {self.dim} dimensions")).cast("array<float>"))
        every = self.rows.unionByName(rows.withColumn("embedding", right).withColumn("seq", F.lit(seq).cast("long")), allowMissingColumns=True)
        return replace(self, rows=buckets.upsert(every, ["vec_id"], ["seq"]))

    def search(self, queries: DataFrame, count: int = 10, filter_: Column | str | None = None) -> DataFrame:
        """q_id, id, score, rank; the filter applies before the search."""
        some = self.rows if filter_ is None else self.rows.where(filter_)
        score = {"int8": search.by_int8, "binary": search.by_sign}.get(self.quant, search.exact)
        return search.top_k(search.prepared(some), search.prepared(queries), score, count, descending=self.quant != "binary").select("q_id", "id", "score", "rank")

    def remove(self, ids: DataFrame) -> VectorMemory:
        return replace(self, rows=buckets.delete(self.rows, ids, "vec_id"))

    def info(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("size")).select("size", F.lit(self.dim).alias("dim"), F.lit(self.quant).alias("quant"), (F.col("size") * V.storage_bytes(F.lit(self.dim), F.lit(self.quant))).alias("bytes"))


def measure_recall(memory: VectorMemory, queries: DataFrame, k: int = 10) -> DataFrame:
    """hits, recall of the memory's own search against exact search."""
    truth = search.top_k(search.prepared(memory.rows), search.prepared(queries), search.exact, k)
    return search.recall(memory.search(queries, k), truth, k)


@dataclass(frozen=True)
class AgentCache:
    """Answers by exact key first, by nearest vector for the rest.  values: a ShardedCache; vectors: vec_id, key, embedding."""

    values: ShardedCache
    vectors: DataFrame
    threshold: float = 0.92

    def get(self, requests: DataFrame, now: int) -> DataFrame:
        """request, kind, value, score.  requests: request (long), key, embedding.  The vector stage sees only what the exact stage missed; a vector whose value
        has expired answers nothing."""
        alive = self.values.live(now).select("key", "value")
        exact = requests.join(alive, "key", "left")
        hits = exact.where("value is not null").select("request", F.lit("exact").alias("kind"), "value", F.lit(None).cast("double").alias("score"))
        rest = exact.where("value is null")
        near = search.top_k(search.prepared(self.vectors), search.prepared(rest, id_="request"), search.exact, 1, same_ids=True).where(F.col("score") >= self.threshold)
        found = near.select(F.col("q_id").alias("request"), F.col("id").alias("vec_id"), "score").join(self.vectors.select("vec_id", "key"), "vec_id").join(alive, "key")
        told = rest.select("request").join(found.select("request", "value", "score"), "request", "left")
        return hits.unionByName(told.select("request", F.when(F.col("value").isNull(), "miss").otherwise("semantic").alias("kind"), "value", "score"))

    def fetch(self, requests: DataFrame, now: int, seq: int, compute: Callable[[DataFrame], DataFrame]) -> tuple[AgentCache, DataFrame]:
        """The cache with what was missing, and request, kind, value, score for every request.  compute: from keys (one row each, however many requests miss
        them) to key, value; what it gives is written out, so that it runs once."""
        told = self.get(requests, now)
        missed = told.where("kind = 'miss'").select("request").join(requests.select("request", "key"), "request")
        made = saved(compute(missed.select("key").distinct()).select("key", "value"), "computed")
        found = missed.join(made, "key", "left").select("request", F.lit("miss").alias("kind"), "value", F.lit(None).cast("double").alias("score"))
        return replace(self, values=self.values.set(made, now, seq)), told.where("kind <> 'miss'").unionByName(found)

    def orphans(self, now: int) -> DataFrame:
        """Vectors whose value is gone."""
        return self.vectors.join(self.values.live(now).select("key"), "key", "left_anti")

    @staticmethod
    def hit_rate(told: DataFrame) -> DataFrame:
        return told.agg(F.coalesce(F.try_divide(F.count_if(F.col("kind") != "miss"), F.count("*")), F.lit(0.0)).alias("rate"))
