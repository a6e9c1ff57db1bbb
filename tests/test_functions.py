"""Column expressions against small plain-Python statements of the same thing."""

import math
import random
import string
import uuid

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelspark.functions import codecs, hashing, sizes, vectors
from keelspark.operators import buckets, ordering, profile, seen, series, state
from keelspark.operators import vectors as search


def units(s):
    b = s.encode("utf-16-be")
    return [b[i] << 8 | b[i + 1] for i in range(0, len(b), 2)]


def fnv(s, h=0x811C9DC5, m=0x01000193):
    for c in units(s):
        h = (h ^ c) * m & 0xFFFFFFFF
    return h


def test_hashes(spark):
    rng = random.Random(1)
    words = ["", "a", "é€", "\U0001f600x", *("".join(rng.choice(string.printable) for _ in range(rng.randint(0, 40))) for _ in range(200))]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "s string").select("s", hashing.fnv1a(F.col("s")).alias("h"), hashing.hash52(F.col("s")).alias("x"))
    for r in df.collect():
        if r.s is None:
            assert r.h is None
        else:
            assert (r.h, r.x) == (fnv(r.s), fnv(r.s) * 2**20 + (fnv(r.s, 0x01000193, 0x85EBCA6B) >> 12))


def size_class(n):
    if n <= 8:
        return 8
    if n <= 128:
        return math.ceil(n / 16) * 16
    step = 2 ** (math.floor(math.log2(n - 1)) - 2) if (n - 1) & (n - 2) else 2 ** ((int(n - 1).bit_length() - 1) - 2)
    return math.ceil(n / step) * step


def test_sizes(spark):
    ns = [0, 1, 8, 9, 16, 17, 127, 128, 129, 130, 160, 161, 255, 256, 257, 320, 512, 513, 4096, 4097, 65535, 65536, 65537, 1 << 29, (1 << 29) + 1]
    got = {r.n: r for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", sizes.size_class(F.col("n")).alias("c"), sizes.sds_header(F.col("n")).alias("h"), sizes.varint_len(F.col("n")).alias("v")).collect()}
    for n in ns:
        assert got[n].c == size_class(n), n
        w = codecs.Writer()
        w.varint(n)
        assert got[n].v == len(w.out)


def test_half_up(spark):
    got = spark.createDataFrame([(x,) for x in (-2.5, -2.4, -0.5, 0.5, 1.5, 2.5)], "x double").select(sizes.js_round(F.col("x")).alias("r")).collect()
    assert [r.r for r in got] == [-2, -2, 0, 1, 2, 3]


def test_key_pattern(spark):
    u = str(uuid.uuid4())
    cases = {"a:1": "a:<n>", "a:-7:b": "a:<n>:b", f"s:{u}": "s:<uuid>", f"s:{u.upper()}": "s:<uuid>", "x:deadbeef": "x:<hex>", "x:deadbee": "x:deadbee", "t:{u1}:v": "t:{*}:v", "k:abcdefghijklmnop": "k:<id>", "k:abcdefghijklmno": "k:abcdefghijklmno", "": "", "12345678": "<n>"}
    got = {r.k: r.p for r in spark.createDataFrame([(k,) for k in cases], "k string").select("k", sizes.key_pattern(F.col("k")).alias("p")).collect()}
    assert got == cases


def test_shard_count(spark):
    got = [r.s for r in spark.createDataFrame([(n,) for n in (0, 1, 124, 125, 20000, 124 * 64, 124 * 64 + 1)], "n long").select(hashing.shard_count(F.col("n")).alias("s")).collect()]
    assert got == [1, 1, 1, 2, 256, 64, 128]


def half(v):
    """The definition, one number at a time."""
    x = int(np.float32(v).view(np.int32)) & 0xFFFFFFFF
    sign, e, m = x >> 16 & 0x8000, x >> 23 & 0xFF, x & 0x7FFFFF
    if e == 255:
        return sign | 0x7C00 | bool(m)
    e -= 112
    if e >= 31:
        return sign | 0x7C00
    if e <= 0:
        return sign if e < -10 else sign | ((m | 0x800000) >> (1 - e)) >> 13
    return sign | e << 10 | m >> 13


@settings(max_examples=300, deadline=None)
@given(st.floats(width=32))
def test_half_bits(v):
    assert int(codecs.half_bits(np.array([v], dtype=np.float32))[0]) == half(v)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**31), 2**31 - 1), st.integers(0, 2**32 - 1), st.text(max_size=50))
def test_wire(signed, unsigned, text):
    w = codecs.Writer()
    w.svarint(signed), w.varint(unsigned), w.text(text)
    r = codecs.Reader(bytes(w.out))
    assert (r.svarint(), r.varint(), r.text(), r.exhausted) == (signed, unsigned, text, True)


def test_schema_rules():
    import pytest

    with pytest.raises(ValueError):
        codecs.Field("x", "enum", tuple(map(str, range(256))))
    with pytest.raises(ValueError):
        codecs.Field("x", "flags", tuple("abcdefghi"))
    s = codecs.Schema((codecs.Field("e", "enum", ("a", "b")),))
    with pytest.raises(ValueError):
        s.encode_one({"e": "c"})
    assert s.decode_one(b"\x01\x09") == {"e": None}


def test_msgpack_sizes():
    assert codecs._msgpack({"a": 1, "b": [True, None, -1, 300, "x" * 40, 1.5]}) == b"\x82\xa1a\x01\xa1b\x96\xc3\xc0\xff\xcd\x01\x2c\xd9\x28" + b"x" * 40 + b"\xcb" + bytes.fromhex("3ff8000000000000")


def test_msgpack_back():
    rng = random.Random(4)

    def some(depth=0):
        kind = rng.randrange(8 if depth < 3 else 6)
        if kind < 2:
            return rng.choice([0, 1, 127, 128, 255, 256, 65_535, 65_536, 2**32, 2**63, -1, -32, -33, -128, -129, -(2**31), -(2**63)])
        if kind == 2:
            return rng.choice(["", "é" * 20, "x" * 31, "x" * 32, "y" * 300, "z" * 70_000])
        if kind == 3:
            return rng.choice([None, True, False])
        if kind == 4:
            return rng.random()
        if kind == 5:
            return bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 300])))
        if kind == 6:
            return [some(depth + 1) for _ in range(rng.choice([0, 3, 20]))]
        return {f"k{i}": some(depth + 1) for i in range(rng.choice([0, 2, 17]))}

    for _ in range(200):
        v = some()
        raw = codecs._msgpack(v)
        assert codecs.msgpack_value(raw) == (v, len(raw))


def test_packing_in_expressions(spark):
    """Built-in expressions and batch reading do what the one-record writer and reader do."""
    import pytest

    fields = [codecs.Field("u", "uuid"), codecs.Field("e", "enum", ("a", "b", "c")), codecs.Field("v", "varint"), codecs.Field("s", "svarint"), codecs.Field("b", "u8"), codecs.Field("f", "flags", ("x", "y")), codecs.Field("t", "str"), codecs.Field("r", "blob")]
    schema = codecs.Schema(tuple(fields), 3)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        rows.append((i, str(uuid.UUID(int=rng.getrandbits(128))), rng.choice("abc"), rng.choice([0, 127, 128, 16_383, 16_384, 2**21 - 1, 2**21, 2**28, 2**32 - 1]), rng.choice([0, -1, 1, 63, -64, 64, 2**31 - 1, -(2**31)]), rng.randrange(256), {"x": rng.random() < 0.5, "y": None if rng.random() < 0.2 else True}, "é" * rng.choice([0, 3, 200]), bytes(rng.randrange(256) for _ in range(rng.choice([0, 4, 130])))))
    df = spark.createDataFrame(rows, "i int, u string, e string, v long, s long, b int, f map<string, boolean>, t string, r binary")
    names = [f.name for f in fields]
    packed = df.select("i", schema.encode(F.struct(*names)).alias("p"))
    raw = {r.i: bytes(r.p) for r in packed.collect()}
    assert raw == {r[0]: schema.encode_one(dict(zip(names, r[1:]))) for r in rows}
    told = {r.i: r.d.asDict() for r in packed.select("i", schema.decode(F.col("p")).alias("d")).collect()}
    for r in rows:
        one = schema.decode_one(raw[r[0]])
        assert {k: bytes(v) if k == "r" else v for k, v in told[r[0]].items()} == one
    old = spark.createDataFrame([(raw[0][:18],), (b"\x01",), (None,)], "p binary").select(schema.decode(F.col("p")).alias("d")).collect()
    assert [r.d["e"] for r in old] == [rows[0][2], None, None] and all(r.d["v"] is None for r in old)
    for bad in (df.limit(1).withColumn("e", F.lit("z")), df.limit(1).withColumn("t", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="no (enum|str)"):
            bad.select(schema.encode(F.struct(*names))).collect()
    with pytest.raises(Exception, match="inside a field"):
        spark.createDataFrame([(raw[0][:12],)], "p binary").select(schema.decode(F.col("p"))).collect()


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack([rng.normal(size=(30, 64)), np.zeros((1, 64))]).astype(np.float32))]
    df = search.prepared(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    for r in df.collect():
        v = np.array(r.v, dtype=np.float64)
        scale = np.abs(v).max() / 127 or 1e-9
        assert np.isclose(r.scale, scale)
        assert r.codes == [int(max(-127, min(127, math.floor(x / scale + 0.5)))) for x in v]
        assert r.sign & (2**64 - 1) == sum(1 << i for i, x in enumerate(v) if x > 0)
    best = search.top_k(df, df.where("id < 3"), search.exact, 4).collect()
    truth = np.array([x[1] for x in rows])
    for q in range(3):
        score = truth @ truth[q] / np.maximum(np.linalg.norm(truth, axis=1) * np.linalg.norm(truth[q]), 1e-12)
        want = [i for i in sorted(range(31), key=lambda i: (-score[i], i)) if i != q][:4]
        assert [r.id for r in sorted((r for r in best if r.q_id == q), key=lambda r: r["rank"])] == want


def test_blocks_of_queries(spark, monkeypatch):
    df = search.prepared(spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<float>"))
    one = {(r.q_id, r.id, r["rank"]) for r in search.top_k(df, df, search.exact, 3).collect()}
    monkeypatch.setattr(search, "MAX_QUERIES", 6)
    assert {(r.q_id, r.id, r["rank"]) for r in search.top_k(df, df, search.exact, 3).collect()} == one


def test_split_moves_by_one_step(spark):
    rows = buckets.split(spark.range(500).select(F.col("id").cast("string").alias("s")), F.col("s"), 4).collect()
    assert all(r.new_bucket in (r.old_bucket, r.old_bucket + 16) for r in rows)


def test_global_order(spark):
    rows = [(i, (i * 7919) % 101, i % 13) for i in range(1000)] + [(1000, None, 5)]
    df = spark.createDataFrame(rows, "i long, x long, w long")
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = sorted(ordering.global_rank(df, "x", tie=["i"]).collect(), key=lambda r: r["rank"])
    assert [r.i for r in got] == [r[0] for r in want] and [r["rank"] for r in got] == list(range(1, 1002))
    run = {r.i: r.running for r in ordering.global_running_sum(df, "w", "x", ["i"]).collect()}
    total = 0
    for i, _, w in want:
        total += w
        assert run[i] == total


def test_one_value_is_many_ranges(spark):
    """A column of one value is spread by its ties, and the ranks still run through."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        df = spark.range(5000).select(F.lit(60).cast("long").alias("ttl"), F.sha1(F.col("id").cast("string")).alias("key"), F.lit(2).alias("memory"))
        parts = ordering._ranged(df, ordering._keys("ttl", True, ["key"])).groupBy("_part").count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < 2500
        got = ordering.global_running_sum(df, "memory", "ttl", ["key"]).collect()
        assert [r.running for r in sorted(got, key=lambda r: r.key)] == [2 * (i + 1) for i in range(5000)]
    finally:
        spark.conf.unset(key)


def test_backoff():
    at, pause, seen = 0, 5_000, [0]
    for _ in range(40):
        at, pause = at + pause, min(100_000, round(pause * 1.6))
        seen.append(at)
    for t in (-5, 0, 1, 5_000, 5_001, 300_000, 1_234_567):
        assert state.backoff_until(t) == next(x for x in seen if x >= t)


def test_nearest_rank(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randint(0, 20))) for _ in range(300)]
    got = {(r.g, r.q): r.v for r in series.nearest_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", (0.0, 0.5, 0.99, 1.0)).collect()}
    for g in "ab":
        xs = sorted(x for k, x in rows if k == g)
        for q in (0.0, 0.5, 0.99, 1.0):
            assert got[g, q] == xs[min(len(xs) - 1, math.floor(q * len(xs)))]


def test_bloom_has_no_misses(spark):
    df = spark.range(400).withColumnRenamed("id", "v")
    m, k = seen.bloom_size(200, 0.01)
    told = {r.v: r.maybe for r in seen.bloom_probe(df, "v", seen.bloom(df.where("v % 2 = 0"), "v", m, k), m, k).collect()}
    assert all(told[v] for v in range(0, 400, 2))
    assert sum(told[v] for v in range(1, 400, 2)) <= 10


def test_eviction_keeps_durable(spark):
    rows = [(f"k{i}", 10, None if i % 3 == 0 else i) for i in range(30)]
    got = {r.key: r for r in state.evict(spark.createDataFrame(rows, "key string, memory long, ttl long"), 0.6).collect()}
    assert not any(r.evicted for r in got.values() if r.ttl is None)
    gone = sorted(r.ttl for r in got.values() if r.evicted)
    assert len(gone) == 12 and max(gone) < min(r.ttl for r in got.values() if not r.evicted and r.ttl is not None)
    tight = state.evict(spark.createDataFrame(rows, "key string, memory long, ttl long"), 0.1).collect()
    assert all(r.oom for r in tight)


def test_fold_of_states(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 5), rng.randint(0, 5), i) for i in range(400)]
    got = {r.key: r for r in state.fold_states(spark.createDataFrame(rows, "u long, t int, i long"), "u", "t", ["i"]).collect()}
    for u in range(6):
        s = v = bad = 0
        for _, t, _ in sorted((r for r in rows if r[0] == u), key=lambda r: r[2]):
            if t in state.LEGAL[s]:
                s, v = t, v + 1
            else:
                bad += 1
        assert (got[u].status, got[u].version, got[u].rejected) == (s, v, bad)


def test_rules_over_odd_keys(spark):
    rows = [(f"h:{i}", "hash", "hashtable", 900, None, 20, None) for i in range(150)] + [(f"z:{i}", "zset", "skiplist", 90_000, None, 1000, None) for i in range(60)] + [(f"v:{i}", "string", "raw", 1300, None, 1024, None) for i in range(1200)]
    keys = spark.createDataFrame(rows, "key string, type string, encoding string, memory long, ttl long, size long, value string")
    found = {(r.rule, r.subject) for r in profile.findings(spark, keys, profile.CONFIG | {"save": "", "maxmemory": "1", "maxmemory-policy": "noeviction", "version": "7.2"}).collect()}
    assert {("hashtable-hashes", "h:<n>"), ("sorted-set-series", "z:<n>"), ("raw-vectors", "v:<n>"), ("no-persistence", "config"), ("client-buffers", "config"), ("old-version", "config")} <= found
    plan = {(r.tier, r.action) for r in profile.fix_plan(keys).collect()}
    assert ("rewrite", "re-encode to listpack") in plan and ("refused", "quantize vectors to int8") in plan


def test_empty_keyspace(spark):
    keys = spark.createDataFrame([], "key string, type string, encoding string, memory long, ttl long, size long, value string")
    assert profile.namespaces(keys).count() == 0
    assert {r.rule for r in profile.findings(spark, keys).collect()} == {"maxmemory-unset", "snapshots-only"}


def test_cosine_of_zero(spark):
    r = spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c")).first()
    assert r.c == 0
