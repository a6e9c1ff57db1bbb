"""Stores, sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from keelspark.functions import hashing
from keelspark.operators import settings
from keelspark.operators.stores import AgentCache, BloomSeen, ExactSeen, Pouch, ShardedCache, VectorMemory, measure_recall, saved
from keelspark.sources import generators, resp, tables
from keelspark.streaming import runs


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_pouch(spark):
    none = spark.createDataFrame([], "id string, value string, seq long")
    p = Pouch(none, capacity=20_000)
    assert p.shards == 256
    p = p.set(spark.createDataFrame([(f"r{i}", f"v{i}") for i in range(300)], "id string, value string"), 1)
    p = p.set(spark.createDataFrame([("r1", "new"), ("x", "y")], "id string, value string"), 2).saved()
    assert {r.id: r.value for r in p.get(ids(spark, "r1", "r2", "no")).collect()} == {"r1": "new", "r2": "v2", "no": None}
    assert p.count().first().n == 301
    assert {r.id: r.has for r in p.has(ids(spark, "x", "no")).collect()} == {"x": True, "no": False}
    asked = spark.createDataFrame([(0, "x"), (1, "no"), (2, "x")], "pos int, id string")
    assert [(r.pos, r.value) for r in p.mget(asked).orderBy("pos").collect()] == [(0, "y"), (1, None), (2, "y")]
    grown, moves = p.split()
    assert grown.shards == 512 and moves.agg(F.sum("total"), F.sum("strays")).first() == (301, 0)
    homes = grown.rows.select(grown.key_for(F.col("id")).alias("new"), grown.prev_key_for(F.col("id")).alias("old"), p.key_for(F.col("id")).alias("before")).collect()
    assert all((r.old or r.new) == r.before for r in homes) and any(r.old for r in homes)
    assert p.delete(ids(spark, "r1", "r2")).count().first().n == 299
    heard = []
    assert p.grow_to(1024, heard.append).shards == 1024
    assert [(h["from"], h["to"], h["scanned"]) for h in heard] == [(256, 512, 301), (512, 1024, 301)] and all(0 < h["moved"] < 301 for h in heard)
    assert Pouch(none, 10).count().first().n == 0


def test_cache(spark):
    c = ShardedCache(spark.createDataFrame([], "key string, value string, expires long, seq long"), ttl=60)
    c = c.set(spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string"), now=100, seq=1)
    c = c.set(spark.createDataFrame([("b", "3")], "key string, value string"), now=150, seq=2, ttl=500)
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert {r.key: r.value for r in c.get(keys, 159).collect()} == {"a": "1", "b": "3", "z": None}
    assert {r.key: r.value for r in c.get(keys, 160).collect()} == {"a": None, "b": "3", "z": None}
    assert {r.key: r.seconds for r in c.ttl_of(keys, 150).collect()} == {"a": 10, "b": 500, "z": None}
    kept = c.persist(keys.where("key = 'a'"))
    assert {r.key: r.value for r in kept.get(keys, 10_000).collect()} == {"a": "1", "b": None, "z": None}
    assert c.delete(keys).live(0).count() == 0


def test_seen(spark):
    s = ExactSeen(ids(spark, "old"))
    s, told = s.add(spark.createDataFrame([("old", 1), ("n", 3), ("n", 2)], "id string, at int"), ["at"])
    assert sorted((r.id, r["at"], r.added) for r in told.collect()) == [("n", 2, True), ("n", 3, False), ("old", 1, False)]
    assert s.count().first().n == 2 and s.remove(ids(spark, "old")).count().first().n == 1
    assert {r.id: r.has for r in s.has(ids(spark, "n", "q")).collect()} == {"n": True, "q": False}
    b = BloomSeen(None, 200).add(ids(spark, *(f"a{i}" for i in range(100)))).add(ids(spark, *(f"b{i}" for i in range(100))))
    told = {r.id: r.maybe for r in b.has(ids(spark, *(f"{c}{i}" for c in "abc" for i in range(100)))).collect()}
    assert all(told[f"{c}{i}"] for c in "ab" for i in range(100)) and sum(told[f"c{i}"] for i in range(100)) <= 6


def test_vector_memory(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, seq long, label string")
    rows = generators.embeddings(spark, 120, dim=16, rank=6).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    m = VectorMemory(none, 16).add(rows, 1)
    m = VectorMemory(saved(m.rows, "vectors"), 16)
    queries = m.rows.where("vec_id < 5")
    assert measure_recall(m, queries, 5).first().recall >= 0.9
    assert all(r.id % 2 for r in m.search(queries, 3, "label = 'odd'").collect())
    assert m.info().first().asDict() == {"size": 120, "dim": 16, "quant": "int8", "bytes": 120 * 20}
    assert m.remove(queries.select("vec_id")).info().first()["size"] == 115
    with pytest.raises(Exception, match="16 dimensions"):
        m.add(spark.createDataFrame([(7, [1.0], "x")], "vec_id long, embedding array<float>, label string"), 2).rows.collect()


def test_agent_cache(spark):
    values = ShardedCache(spark.createDataFrame([("k0", "zero", 100, 1), ("k1", "one", 100, 1), ("k2", "two", 5, 1)], "key string, value string, expires long, seq long"))
    vectors = spark.createDataFrame([(0, "k0", [1.0, 0.0]), (1, "k1", [0.0, 1.0]), (2, "k2", [-1.0, 0.0])], "vec_id long, key string, embedding array<float>")
    c = AgentCache(values, vectors)
    asked = spark.createDataFrame([(0, "k1", [1.0, 0.0]), (1, "q", [0.99, 0.02]), (2, "q", [-1.0, 0.0]), (3, "q", [0.7, 0.7])], "request long, key string, embedding array<float>")
    told = c.get(asked, 10)
    assert {r.request: (r.kind, r.value) for r in told.collect()} == {0: ("exact", "one"), 1: ("semantic", "zero"), 2: ("miss", None), 3: ("miss", None)}
    assert [r.key for r in c.orphans(10).collect()] == ["k2"]
    assert AgentCache.hit_rate(told).first().rate == 0.5 and AgentCache.hit_rate(told.limit(0)).first().rate == 0


def test_fetch_computes_once(spark, tmp_path):
    none = spark.createDataFrame([], "key string, value string, expires long, seq long")
    c = AgentCache(ShardedCache(none), spark.createDataFrame([], "vec_id long, key string, embedding array<float>"))
    asked = spark.createDataFrame([(i, f"k{i % 3}", [1.0, 0.0]) for i in range(9)], "request long, key string, embedding array<float>")
    calls = []

    def compute(keys):
        calls.append(keys.count())
        return keys.withColumn("value", F.concat(F.lit("made "), "key"))

    c, told = c.fetch(asked, 10, 1, compute)
    assert {r.request: (r.kind, r.value) for r in told.collect()} == {i: ("miss", f"made k{i % 3}") for i in range(9)}
    c, told = c.fetch(asked, 11, 2, compute)
    assert {(r.kind, r.value) for r in told.collect()} == {("exact", f"made k{i}") for i in range(3)} and calls == [3, 0]


def test_long_groups_are_spread(spark):
    from keelspark.operators import ordering

    rows = [(1 if i < 900 else i % 7, i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, t int, i int")
    want, prev = {}, {}
    for g, t, i in sorted(rows):
        mine = prev.setdefault(g, [])
        mine.append(t)
        want[i] = (len(mine), [None] * max(0, 3 - len(mine)) + mine[-3:])
    total = {g: len(v) for g, v in prev.items()}
    for hot in (50, 10**6):
        assert {r.i: (r.row, r.rows) for r in ordering.numbered_in(df, ["g"], ["t", "i"], hot).collect()} == {i: (want[i][0], total[g]) for g, _, i in rows}
    for block in (7, 10**6):
        got = ordering.with_rows_before(df, ["g"], ["t", "i"], ["t"], 2, block).collect()
        assert {r.i: [None if b is None else b.t for b in r.before] for r in got} == {i: w for i, (_, w) in want.items()} and len(got) == 1000


def test_cache_fields(spark):
    keys = ["", "a", "k" * 20, "é" * 20, "abcdefghijk€", "\U0001f600" * 5]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.cache_field(F.col("k")).alias("f"), hashing.agent_field(F.col("k")).alias("a"), hashing.fnv1a(F.col("k")).alias("h")).collect()
    for r in got:
        head = b""
        for ch in r.k[:12]:
            if len(head) + len(ch.encode()) > 12:
                break
            head += ch.encode()
        assert bytes(r.f) == r.h.to_bytes(4, "big") + head.ljust(12, b"\0") and bytes(r.a)[:4] == bytes(r.f)[:4] and len(r.a) == 8


def test_resp(spark, tmp_path):
    one, two = resp.encode("SET", "k", b"\r\n\x00"), resp.encode("DEL", 7)
    assert resp.parse(one) == ([b"SET", b"k", b"\r\n\x00"], len(one))
    assert resp.parse(b"*4\r\n:5\r\n$-1\r\n+ok\r\n*0\r\n")[0] == [5, None, "ok", []]
    error, _ = resp.parse(b"-ERR bad\r\n")
    with pytest.raises(resp.ReplyError, match="bad"):
        resp.value(error)
    for cut in range(len(one)):
        with pytest.raises(resp.Incomplete):
            resp.parse(one[:cut])
    (tmp_path / "log.aof").write_bytes(one + two + one[:-3])
    got = resp.command_log(spark, str(tmp_path)).orderBy("position").collect()
    assert [[bytes(a) for a in r.args] for r in got] == [[b"SET", b"k", b"\r\n\x00"], [b"DEL", b"7"]]
    out = tmp_path / "sent"
    out.mkdir()

    def send(rows, out=str(out)):
        import os
        import uuid

        with open(os.path.join(out, uuid.uuid4().hex), "w") as f:
            f.write(str(len(rows)))

    resp.send_batches(spark.range(0, 2500, 1, 2), send)
    sizes = sorted(int(p.read_text()) for p in out.iterdir())
    assert sum(sizes) == 2500 and max(sizes) == 1000


def test_sources_and_sinks(spark, tmp_path):
    assert tables.info("# Memory\nused_memory:10\r\nmode:a:b\n") == {"used_memory": "10", "mode": "a:b"}
    (tmp_path / "words.txt").write_text("one\n\n two \none\n")
    assert {r.word for r in tables.word_list(spark, str(tmp_path / "words.txt"), []).collect()} == {"one", "two"}
    assert {r.word for r in tables.word_list(spark, None, ["x"]).collect()} == {"x"}
    (tmp_path / "b.json").write_text(json.dumps({"cases": [{"id": 1}, {"id": 2}]}, indent=1))
    assert tables.json_source(spark, str(tmp_path / "b.json")).select(F.explode("cases.id")).count() == 2
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    tables.json_sink(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().s == "a"
    assert tables.markdown(df) == "| n | s |\n| --- | --- |\n| 1 | a |"


def test_settings(spark):
    assert settings.Layout(templates=True).settings() == {"hash-max-listpack-entries": "512", "hash-max-listpack-value": "512", "hash-min-template-entries": "4"}
    assert settings.SafeEviction(5).settings() == {"maxmemory-policy": "volatile-ttl", "maxmemory": "5"}
    rows = spark.createDataFrame([("12",), ("x",), (None,), ("NaN",), ("-ERR",), ("Infinity",)], "t string").select(settings.number(F.col("t")).alias("n"), settings.is_error(F.col("t")).alias("e")).collect()
    assert [r.n for r in rows] == [12, 0, 0, 0, 0, 0] and [r.e for r in rows] == [False, False, False, False, True, False]
    ttl = spark.createDataFrame([(None,), (5,)], "t int").select(settings.is_candidate(F.col("t")).alias("v"), settings.is_candidate(F.col("t"), "allkeys-lru").alias("a"), settings.is_candidate(F.col("t"), "noeviction").alias("n")).collect()
    assert [tuple(r) for r in ttl] == [(False, True, False), (True, True, False)]


def test_streams_over_several_triggers(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(i % 4, (1, 2, 1, 3, 5)[i % 5], i, i) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], "user_id long, target int, ts long, event_id long").coalesce(1).write.mode("append").parquet(path)
    stream = runs.source(spark, path, files_per_trigger=1)
    got = {r.user_id: (r.status, r.version, r.rejected) for r in runs.latest(runs.settle(runs.fold_states(stream), "update", "t"), "user_id").collect()}
    from keelspark.operators.state import fold_states

    want = {r.key: (r.status, r.version, r.rejected) for r in fold_states(spark.read.parquet(path), "user_id", "target", ["ts", "event_id"]).collect()}
    assert {u: v[1] + v[2] for u, v in got.items()} == {u: v[1] + v[2] for u, v in want.items()}
    timed = spark.createDataFrame([(u, t) for u in range(3) for t in (1, 2, 3)], "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    timed.write.parquet(str(tmp_path / "timed"))
    once = runs.settle(runs.first_seen(runs.source(spark, str(tmp_path / "timed")), ["user_id"], late="1 hour"), "append", "w")
    assert once.count() == 3


def test_generators_repeat(spark):
    assert generators.runs(spark, 50).exceptAll(generators.runs(spark, 50).repartition(7)).count() == 0
    assert generators.runs(spark, 5, seed=1).select("run_id").intersect(generators.runs(spark, 5, seed=2).select("run_id")).count() == 0
    assert hashing.fnv1a(F.lit("")) is not None
