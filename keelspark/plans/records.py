"""Queries over record encodings and storage layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import sizes as S
from ..operators import layouts as L
from ..operators.series import epoch_s
from ..sources.keyspace import order_json
from ..sources.tables import table
from . import sqltext as T
from .registry import measured, query


@query("varint_bytes", f"SELECT l_orderkey, l_linenumber, {T.varint('v')} AS n, {T.varint('z')} AS n_signed FROM (SELECT l_orderkey, l_linenumber, v, CASE WHEN w >= 0 THEN w * 2 ELSE w * -2 - 1 END AS z FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey * l_partkey * 97 % 5000000000 AS BIGINT) AS v, CAST(l_partkey * 31 - l_orderkey * 7 AS BIGINT) AS w FROM lineitem))")
def varint_bytes(spark, d):
    v = F.col("l_orderkey") * F.col("l_partkey") * 97 % F.lit(5_000_000_000)
    w = F.col("l_partkey") * 31 - F.col("l_orderkey") * 7
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.varint_len(v).alias("n"), S.varint_len(S.zigzag(w)).alias("n_signed"))


_UUID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"


@query("uuid_roundtrip", f"SELECT o_orderkey, {_UUID} AS back, 16 AS width FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders)")
def uuid_roundtrip(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("m"))
    packed = rows.select("o_orderkey", S.uuid_bytes(F.upper(F.expr(_UUID))).alias("b"))
    return packed.select("o_orderkey", S.field_text(F.col("b")).alias("back"), F.octet_length("b").alias("width"))


@query("task_pack", "SELECT o_orderkey, (p & 15) | ((a & 15) << 4) AS packed, p, a FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, CAST(o_custkey % 4 AS INTEGER) AS a FROM orders)")
def task_pack(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p0"), (F.col("o_custkey") % 4).cast("int").alias("a0"))
    packed = rows.select("o_orderkey", F.col("p0").bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(F.col("a0").bitwiseAND(F.lit(15)), 4)).alias("packed"))
    return packed.select("o_orderkey", "packed", F.col("packed").bitwiseAND(F.lit(15)).alias("p"), F.shiftright("packed", 4).alias("a"))


@query("span_flags", "SELECT event_id, ok | (hit << 1) | ((retry & 7) << 2) AS flags, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 255 END AS code FROM (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok, CAST(user_id % 2 AS INTEGER) AS hit, CAST(event_id % 9 AS INTEGER) AS retry FROM events)")
def span_flags(spark, d):
    ok, hit, retry = F.when(F.col("event_type") == "error", 0).otherwise(1), (F.col("user_id") % 2).cast("int"), (F.col("event_id") % 9).cast("int")
    members = F.array(*map(F.lit, ("click", "view", "purchase")))
    place = F.array_position(members, F.col("event_type")).cast("int")
    return table(spark, d, "events").select("event_id", ok.bitwiseOR(F.shiftleft(hit, 1)).bitwiseOR(F.shiftleft(retry.bitwiseAND(F.lit(7)), 2)).alias("flags"), F.when(place == 0, 255).otherwise(place - 1).alias("code"))


@query("json_encode_bytes", f"SELECT o_orderkey, {T.ORDER_JSON} AS json, strlen({T.ORDER_JSON}) AS bytes FROM orders")
def json_encode_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", order_json().alias("json")).withColumn("bytes", F.octet_length("json"))


_LONG = (("o_orderkey", "k"), ("o_custkey", "c"), ("o_orderstatus", "s"), ("o_orderpriority", "p"))


@query("short_names_bytes", "SELECT sum(strlen(CAST(to_json(struct_pack(o_orderkey := o_orderkey, o_custkey := o_custkey, o_orderstatus := o_orderstatus, o_orderpriority := o_orderpriority)) AS VARCHAR)))::BIGINT AS long_bytes, sum(strlen(CAST(to_json(struct_pack(k := o_orderkey, c := o_custkey, s := o_orderstatus, p := o_orderpriority)) AS VARCHAR)))::BIGINT AS short_bytes FROM orders")
def short_names_bytes(spark, d):
    rows = table(spark, d, "orders")
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*[a for a, _ in _LONG])))).cast("long").alias("long_bytes"), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(a).alias(b) for a, b in _LONG])))).cast("long").alias("short_bytes"))


#: the run record of this library's examples
RUN = C.Schema((C.Field("run_id", "uuid"), C.Field("status", "enum", ("O", "F", "P")), C.Field("model", "enum", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")), C.Field("created", "varint"), C.Field("delta", "svarint"), C.Field("customer", "varint"), C.Field("cents", "varint"), C.Field("flags", "flags", ("paid", "late")), C.Field("note", "str")))
OLD = C.Schema(RUN.fields[:-2])
NEW = C.Schema((*RUN.fields, C.Field("extra", "u8")), version=2)


def _runs(spark, d):
    m = F.md5(F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)).alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("model"),
        epoch_s(F.col("o_orderdate")).alias("created"), ((F.col("o_orderkey") % 200) - 100).alias("delta"), F.col("o_custkey").alias("customer"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.struct((F.col("o_orderstatus") == "F").alias("paid"), (F.col("o_orderkey") % 3 == 0).alias("late")).alias("flags"), F.concat(F.lit("note "), F.col("o_custkey") % 1000).alias("note"), F.lit(7).alias("extra"),
    )


_RUN_SQL = f"""SELECT o_orderkey, 1 + 16 + 1 + 1 + {T.varint('CAST(epoch(o_orderdate) AS BIGINT)')} + {T.varint('(CASE WHEN (o_orderkey % 200) - 100 >= 0 THEN ((o_orderkey % 200) - 100) * 2 ELSE ((o_orderkey % 200) - 100) * -2 - 1 END)')} + {T.varint('o_custkey')} + {T.varint('CAST(round(o_totalprice * 100) AS BIGINT)')} + 1 + 1 + strlen('note ' || (o_custkey % 1000)) AS bytes FROM orders"""


@query("record_pack_size", _RUN_SQL)
def record_pack_size(spark, d):
    r = _runs(spark, d)
    size = F.lit(1 + 16 + 1 + 1) + S.varint_len(F.col("created")) + S.varint_len(S.zigzag(F.col("delta"))) + S.varint_len(F.col("customer")) + S.varint_len(F.col("cents")) + 1 + 1 + F.octet_length("note")
    return r.select("o_orderkey", size.cast("long").alias("bytes"))


@query("record_codec", f"SELECT o_orderkey, bytes, true AS same FROM ({_RUN_SQL})")
def record_codec(spark, d):
    names = [f.name for f in RUN.fields]
    packed = _runs(spark, d).withColumn("b", RUN.encode(F.struct(*names))).withColumn("back", RUN.decode(F.col("b")))
    plain = [n for n in names if n != "flags"]
    same = (F.to_json(F.struct(*plain)) == F.to_json(F.struct(*[F.col(f"back.{n}").alias(n) for n in plain]))) & (F.col("flags.paid") == F.col("back.flags")["paid"]) & (F.col("flags.late") == F.col("back.flags")["late"])
    return packed.select("o_orderkey", F.octet_length("b").cast("long").alias("bytes"), same.alias("same"))


@query("schema_evolution", "SELECT count(*) AS n, 1 AS old_version, 2 AS new_version, true AS old_is_null, true AS new_is_ignored FROM orders")
def schema_evolution(spark, d):
    rows = _runs(spark, d).withColumn("old", OLD.encode(F.struct(*[f.name for f in OLD.fields]))).withColumn("new", NEW.encode(F.struct(*[f.name for f in NEW.fields])))
    read = rows.select("run_id", "note", RUN.decode(F.col("old")).alias("a"), RUN.decode(F.col("new")).alias("b"), C.version_of(F.col("old")).alias("va"), C.version_of(F.col("new")).alias("vb"))
    return read.agg(F.count("*").alias("n"), F.max("va").alias("old_version"), F.max("vb").alias("new_version"), F.min(F.col("a.note").isNull() & F.col("a.flags").isNull() & (F.col("a.run_id") == F.col("run_id"))).alias("old_is_null"), F.min((F.col("b.note") == F.col("note")) & (F.col("b.run_id") == F.col("run_id"))).alias("new_is_ignored"))


@query("schema_describe", "SELECT * FROM (VALUES (0, 'version', 'u8', 1), (1, 'run_id', 'uuid', 16), (2, 'status', 'enum(3)', 1), (3, 'model', 'enum(5)', 1), (4, 'created', 'varint', 2), (5, 'delta', 'svarint', 2), (6, 'customer', 'varint', 2), (7, 'cents', 'varint', 2), (8, 'flags', 'flags(2)', 1), (9, 'note', 'str', 24)) t(position, name, kind, typical)")
def schema_describe(spark, d):
    return spark.createDataFrame(RUN.describe(), "position int, name string, kind string, typical int")


@query("msgpack_bytes", "SELECT turn, count(*) AS n, CAST(sum(1 + 5 + (1 + strlen(role)) + 5 + (CASE WHEN turn < 128 THEN 1 ELSE 2 END) + 5 + (CASE WHEN strlen(text) < 32 THEN 1 WHEN strlen(text) < 256 THEN 2 WHEN strlen(text) < 65536 THEN 3 ELSE 5 END) + strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY turn")
def msgpack_bytes(spark, d):
    rows = table(spark, d, "conversations").select("turn", C.msgpack_json(F.to_json(F.struct("role", "turn", "text"))).alias("b"))
    return rows.groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.octet_length("b")).cast("long").alias("bytes"))


@query("msgpack_roundtrip", "SELECT conv_id, turn, role, CASE WHEN strlen(text) > 0 THEN md5(text) END AS text FROM conversations WHERE text IS NOT NULL")
def msgpack_roundtrip(spark, d):
    """JSON to MessagePack and back."""
    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", C.json_msgpack(C.msgpack_json(F.to_json(F.struct("role", "turn", "text")))).alias("j"))
    back = rows.select("conv_id", F.from_json("j", "role string, turn bigint, text string").alias("b"))
    return back.select("conv_id", "b.turn", "b.role", F.when(F.octet_length("b.text") > 0, F.md5("b.text")).alias("text"))


@query("dict_compress", "SELECT conv_id, turn, md5(text) AS back, strlen(text) AS bytes, text IS NOT NULL AS smaller FROM conversations WHERE text IS NOT NULL AND strlen(text) >= 64")
def dict_compress(spark, d):
    """Round trip with a dictionary of the first turns; smaller than the text wherever that is long enough."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    words = C.make_dictionary([r["text"].encode() for r in rows.where("text is not null").orderBy("conv_id", "turn").limit(64).collect()])
    packed = rows.withColumn("z", C.deflate_with(words)(F.col("text"))).withColumn("back", C.inflate_with(words)(F.col("z")).cast("string"))
    return packed.where(F.octet_length("text") >= 64).select("conv_id", "turn", F.md5("back").alias("back"), F.octet_length("back").cast("long").alias("bytes"), (F.octet_length("z") < F.octet_length("text")).alias("smaller"))


@query("zstd_roundtrip", "SELECT conv_id, turn, md5(text) AS back, strlen(text) AS bytes FROM conversations")
def zstd_roundtrip(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text")
    back = rows.select("conv_id", "turn", C.unzstd(C.zstd()(F.col("text"))).alias("b"))
    return back.select("conv_id", "turn", F.md5("b").alias("back"), F.octet_length("b").cast("long").alias("bytes"))


def _case(name: str, source: str, variants: dict[str, str]) -> str:
    """The oracle of a layout: variants as SQL expressions over the source."""
    first = next(iter(variants.values()))
    return " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS records, round(sum({e}) * 1.0 / count(*), 4) AS bytes, round(sum({first}) * 1.0 / sum({e}), 4) AS ratio FROM ({source})" for v, e in variants.items())


_VALUE = lambda n: T.size_class(f"({n} + {T.sds(n)} + 1)")
_KEYCOST = lambda n: f"(48 + {T.size_class(f'({n} + 4)')})"
_RUNSRC = f"SELECT strlen({T.ORDER_JSON}) AS j, 6 AS f, strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR)) + 1 + 10 + strlen(o_orderpriority) + strlen(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)) AS v, 67 AS names, strlen('order:' || o_orderkey) AS k, (SELECT bytes FROM ({_RUN_SQL}) r WHERE r.o_orderkey = o.o_orderkey) AS p FROM orders o"


@query("layout_run_state", _case("run", _RUNSRC, {
    "key-per-field": f"f * {_KEYCOST('(k + 12)')} + v", "hash-hashtable": f"{_KEYCOST('k')} + f * 64 + names + v", "hash-listpack": f"{_KEYCOST('k')} + f * 2 * 4 + names + v", "hash-template": f"{_KEYCOST('k')} + f * 4 + v", "hash-short-names": f"{_KEYCOST('k')} + f * 2 * 4 + 6 + v",
    "hash-short-template": f"{_KEYCOST('k')} + f * 4 + 6 / 128.0 + v", "json-string": f"{_KEYCOST('k')} + {_VALUE('j')}", "packed-string": f"{_KEYCOST('k')} + {_VALUE('p')}", "sharded-128": f"{_KEYCOST('12')} / 128.0 + 16 + p + 2 * 4", "sharded-1024": f"{_KEYCOST('12')} / 1024.0 + 16 + p + 64", "sharded-json": f"{_KEYCOST('12')} / 128.0 + 16 + j + 2 * 4",
}))
def layout_run_state(spark, d):
    runs = record_pack_size(spark, d).withColumnRenamed("bytes", "p")
    o = table(spark, d, "orders").withColumn("j", F.octet_length(order_json())).withColumn("k", F.octet_length(F.concat(F.lit("order:"), "o_orderkey")))
    text = lambda c: F.octet_length(c.cast("string"))
    o = o.withColumn("v", text(F.col("o_orderkey")) + text(F.col("o_custkey")) + 11 + F.octet_length("o_orderpriority") + text(F.round(F.col("o_totalprice") * 100).cast("long")))
    k, v, j, p = map(F.col, "kvjp")
    shard = L.key_cost(12)
    return L.compare(o.join(runs, "o_orderkey"), {
        "key-per-field": L.key_cost(k + 12) * 6 + v, "hash-hashtable": L.key_cost(k) + 6 * L.HASHTABLE + 67 + v, "hash-listpack": L.key_cost(k) + 12 * L.LISTPACK + 67 + v, "hash-template": L.key_cost(k) + 6 * L.LISTPACK + v, "hash-short-names": L.key_cost(k) + 12 * L.LISTPACK + 6 + v,
        "hash-short-template": L.key_cost(k) + 6 * L.LISTPACK + F.lit(6 / 128) + v, "json-string": L.key_cost(k) + L.value_cost(j), "packed-string": L.key_cost(k) + L.value_cost(p), "sharded-128": shard / 128 + 16 + p + 2 * L.LISTPACK, "sharded-1024": shard / 1024 + 16 + p + L.HASHTABLE, "sharded-json": shard / 128 + 16 + j + 2 * L.LISTPACK,
    })


_TURNSRC = "SELECT strlen(text) AS t, strlen(role) AS r FROM conversations"


@query("layout_transcript", _case("turns", _TURNSRC, {"json-list": "t + r + 42 + 3", "msgpack-list": "t + r + 22 + 3", "stream-fields": "t + r + 16 + 12 + 3 * 4", "stream-packed": "t + 5 + 12", "packed-list": "t + 1 + 4 + 3", "chunk-16": "t + 1 + 4 + 3 / 16.0"}))
def layout_transcript(spark, d):
    rows = table(spark, d, "conversations").select(F.octet_length("text").alias("t"), F.octet_length("role").alias("r"))
    t, r = F.col("t"), F.col("r")
    return L.compare(rows, {"json-list": t + r + 42 + L.LIST, "msgpack-list": t + r + 22 + L.LIST, "stream-fields": t + r + 16 + L.STREAM + 3 * L.LISTPACK, "stream-packed": t + 5 + L.STREAM, "packed-list": t + 1 + 4 + L.LIST, "chunk-16": t + 5 + F.lit(L.LIST) / 16})


_SPANSRC = "SELECT strlen(event_type) AS e, strlen(props) AS p, strlen(CAST(event_id AS VARCHAR)) AS k, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)"


@query("layout_spans", _case("spans", _SPANSRC, {"hash-per-span": f"{_KEYCOST('(k + 5)')} + e + p + 30 + 6 * 8", "json-list": "e + p + 60 + 3", "stream-fields": "e + p + 30 + 12 + 6 * 4", "stream-msgpack": "e + p + 22 + 12", "stream-packed": "p + 20 + 12", "packed-list": "p + 20 + 3", "sharded-hash": "p + 20 + 16 + 8", "last-20-lossy": "CASE WHEN rn <= 20 THEN p + 20 + 12 ELSE 0 END"}))
def layout_spans(spark, d):
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = table(spark, d, "events").select(F.octet_length("event_type").alias("e"), F.octet_length("props").alias("p"), F.octet_length(F.col("event_id").cast("string")).alias("k"), rn.alias("rn"))
    e, p, k = F.col("e"), F.col("p"), F.col("k")
    return L.compare(rows, {"hash-per-span": L.key_cost(k + 5) + e + p + 30 + 12 * L.LISTPACK, "json-list": e + p + 60 + L.LIST, "stream-fields": e + p + 30 + L.STREAM + 6 * L.LISTPACK, "stream-msgpack": e + p + 22 + L.STREAM, "stream-packed": p + 20 + L.STREAM, "packed-list": p + 20 + L.LIST, "sharded-hash": p + 20 + 16 + 2 * L.LISTPACK, "last-20-lossy": F.when(F.col("rn") <= 20, p + 20 + L.STREAM).otherwise(0)})


_VECSRC = "SELECT len(embedding) AS n, strlen('emb:' || vec_id) AS k FROM embeddings"
_VECS = {"json-string": 11.5, "f32": 4, "f16": 2, "int8": 1, "binary": 0.125}


@query("layout_vectors", _case("vectors", _VECSRC, {**{v: f"{_KEYCOST('k')} + {_VALUE(f'CAST(ceil(n * {b}) + {4 if v == 'int8' else 0} AS BIGINT)')}" for v, b in _VECS.items()}, "sharded-int8": "16 + n + 4 + 8", "indexed-int8": "16 + n + 4 + 16 * 8 * 2", "indexed-f32": "16 + n * 4 + 16 * 8 * 2", "indexed-binary": "16 + ceil(n / 8.0) + 16 * 8 * 2", "indexed-half-int8": "16 + n / 2 + 4 + 16 * 8 * 2", "indexed-quarter-binary": "16 + ceil(n / 32.0) + 16 * 8 * 2"}))
def layout_vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.size("embedding").alias("n"), F.octet_length(F.concat(F.lit("emb:"), "vec_id")).alias("k"))
    n, k = F.col("n"), F.col("k")
    plain = {v: L.key_cost(k) + L.value_cost(F.ceil(n * F.lit(float(b))) + (4 if v == "int8" else 0)) for v, b in _VECS.items()}
    return L.compare(rows, plain | {"sharded-int8": n + 16 + 4 + 2 * L.LISTPACK, "indexed-int8": n + 16 + 4 + 256, "indexed-f32": n * 4 + 16 + 256, "indexed-binary": F.ceil(n / 8) + 16 + 256, "indexed-half-int8": n / 2 + 16 + 4 + 256, "indexed-quarter-binary": F.ceil(n / 32) + 16 + 256})


@query("layout_dedup", _case("ids", "SELECT 36 AS n FROM orders", {"uuid-set": "n + 64", "key-per-id": f"{_KEYCOST('n')}", "int-set": "8 + 64", "sharded-intset": "8 + 16 / 244.0", "bloom-1pct": "9.5851 / 8", "bloom-01pct": "14.3776 / 8", "cuckoo": "1.6", "hyperloglog": "12304.0 / (SELECT count(*) FROM orders)"}))
def layout_dedup(spark, d):
    n = F.lit(36)
    ids = table(spark, d, "orders").select("o_orderkey")
    return L.compare(ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("all")))), {"uuid-set": n + L.HASHTABLE, "key-per-id": L.key_cost(n), "int-set": F.lit(8 + L.HASHTABLE), "sharded-intset": F.lit(8 + 16 / 244), "bloom-1pct": F.lit(9.5851 / 8), "bloom-01pct": F.lit(14.3776 / 8), "cuckoo": F.lit(1.6), "hyperloglog": F.lit(12304.0) / F.col("all")})


@query("layout_cache", _case("entries", "SELECT strlen(text) AS v FROM conversations", {"key-expire": f"{_KEYCOST('36')} + {_VALUE('v')} + 24", "key": f"{_KEYCOST('36')} + {_VALUE('v')}", "sharded": "36 + v + 8", "sharded-expire": "36 + v + 8 + 8", "sharded-16b": "16 + v + 8 + 8"}))
def layout_cache(spark, d):
    v = F.octet_length("text")
    return L.compare(table(spark, d, "conversations").select("text"), {"key-expire": L.key_cost(36) + L.value_cost(v) + 24, "key": L.key_cost(36) + L.value_cost(v), "sharded": v + 36 + 2 * L.LISTPACK, "sharded-expire": v + 36 + 2 * L.LISTPACK + 8, "sharded-16b": v + 16 + 2 * L.LISTPACK + 8})


_MEMBERS = """SELECT tag, id, CASE WHEN id < 32768 THEN 2 WHEN id < 2147483648 THEN 4 ELSE 8 END AS wide, CAST(floor(top / 8) + 1 AS BIGINT) / n AS bits, least(1.0, ceil(n / 400.0) * 16.0 / n) AS shard
FROM (SELECT DISTINCT l_returnflag || l_linestatus AS tag, l_orderkey AS id FROM lineitem) JOIN (SELECT l_returnflag || l_linestatus AS tag, count(DISTINCT l_orderkey) AS n, max(l_orderkey) AS top FROM lineitem GROUP BY 1) USING (tag)"""


@query("layout_index", _case("memberships", _MEMBERS, {"uuid-set": "36 + 64", "sorted-set": "36 + 64 + 16", "int-set": "8 + 64", "sharded-intset": "wide + shard", "text-set": "strlen(CAST(id AS VARCHAR)) + 64", "bitmap": "bits"}))
def layout_index(spark, d):
    """Memberships of ids in tags; bitmaps and shards by the tags' own sizes."""
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("tag"), F.col("l_orderkey").alias("id")).distinct()
    tags = rows.groupBy("tag").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    i, n = F.col("id"), F.col("n")
    wide = F.when(i < 32768, 2).when(i < 1 << 31, 4).otherwise(8)
    shard = F.least(F.lit(1.0), F.ceil(n / 400.0) * 16.0 / n)
    return L.compare(rows.join(F.broadcast(tags), "tag"), {"uuid-set": F.lit(36 + L.HASHTABLE), "sorted-set": F.lit(36 + L.HASHTABLE + 16), "int-set": F.lit(8 + L.HASHTABLE), "sharded-intset": wide + shard, "text-set": F.octet_length(i.cast("string")) + L.HASHTABLE, "bitmap": (F.floor(F.col("top") / 8) + 1) / n})


_INT = lambda c: f"(CASE WHEN {c} < 128 THEN 1 WHEN {c} < 256 THEN 2 WHEN {c} < 65536 THEN 3 ELSE 5 END)"
_TASKS = f"SELECT strlen(CAST(to_json(struct_pack(task := o_orderkey, run := o_custkey, kind := o_orderpriority)) AS VARCHAR)) AS j, 1 + 5 + {_INT('o_orderkey')} + 4 + {_INT('o_custkey')} + 5 + 1 + strlen(o_orderpriority) AS m, {T.varint('o_orderkey')} + {T.varint('o_custkey')} + 1 AS p FROM orders"


@query("layout_queue", _case("tasks", _TASKS, {"json-list": "j + 3", "msgpack-list": "m + 3", "packed-list": "p + 3", "stream": "j + 12 + 3 * 4", "stream-packed": "p + 12", "stream-pending": "p + 12 + 238", "stream-acked": "p + 12", "delayed-set": "j + 64 + 16"}))
def layout_queue(spark, d):
    """Tasks as they would be written: JSON, MessagePack and packed sizes of each row."""
    o = table(spark, d, "orders")
    size = lambda c: F.when(F.col(c) < 128, 1).when(F.col(c) < 256, 2).when(F.col(c) < 65536, 3).otherwise(5)
    varint = lambda c: F.when(F.col(c) < 1 << 7, 1).when(F.col(c) < 1 << 14, 2).when(F.col(c) < 1 << 21, 3).when(F.col(c) < 1 << 28, 4).otherwise(5)
    rows = o.select(
        F.octet_length(F.to_json(F.struct(F.col("o_orderkey").alias("task"), F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("kind")))).alias("j"),
        (F.lit(16) + size("o_orderkey") + size("o_custkey") + F.octet_length("o_orderpriority")).alias("m"), (varint("o_orderkey") + varint("o_custkey") + 1).alias("p"),
    )
    j, m, p = F.col("j"), F.col("m"), F.col("p")
    return L.compare(rows, {"json-list": j + L.LIST, "msgpack-list": m + L.LIST, "packed-list": p + L.LIST, "stream": j + L.STREAM + 3 * L.LISTPACK, "stream-packed": p + L.STREAM, "stream-pending": p + L.STREAM + 238, "stream-acked": p + L.STREAM, "delayed-set": j + L.HASHTABLE + 16})


_XOR = lambda c: f"CASE WHEN {c} IS NULL THEN 64 WHEN {c} = 0 THEN 1 ELSE 2 + 11 + length(bin({c})) END"
_DD = f"""SELECT CASE WHEN dd IS NULL THEN 64 WHEN dd = 0 THEN 1 WHEN abs(dd) < 64 THEN 9 WHEN abs(dd) < 256 THEN 12 WHEN abs(dd) < 2048 THEN 16 ELSE 36 END AS bits, {_XOR('xor(a, a0)')} AS one, {_XOR('xor(b, b0)')} AS two, {_XOR('xor(c, c0)')} AS six, strlen(CAST(s AS VARCHAR)) + 1 + strlen(CAST(a AS VARCHAR)) AS said
FROM (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dd FROM (SELECT *, s - lag(s) OVER w AS d, lag(a) OVER w AS a0, lag(b) OVER w AS b0, lag(c) OVER w AS c0
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(value + 0.5) AS BIGINT) AS a, CAST(floor(value * 100 + 0.5) AS BIGINT) AS b, CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


@query("layout_metrics", _case("samples", _DD, {"sorted-set": "said + 64 + 16", "stream": "said + 12 + 4", "hash": "said + 8", "series-raw": "16.0", "series-integer": "(bits + one) / 8.0", "series-two-decimals": "(bits + two) / 8.0", "series-noise": "(bits + six) / 8.0", "series-and-hourly": "(bits + one) / 8.0 + 16 / 360.0"}))
def layout_metrics(spark, d):
    """Samples by what they take: text in containers, and in series the bits of the step of steps and of the value against the one before, rounded to units,
    hundredths or millionths."""
    from ..operators.ordering import with_rows_before

    half = lambda k: F.floor(F.col("value") * k + 0.5).cast("long")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", epoch_s(F.col("ts")).alias("s"), half(1).alias("a"), half(100).alias("b"), half(1_000_000).alias("c"))
    seen = with_rows_before(rows, ["user_id"], ["ts", "event_id"], ["s", "a", "b", "c"], 2)
    at = lambda i, c: F.col("before")[i][c]
    dd = F.abs(at(2, "s") - at(1, "s") - (at(1, "s") - at(0, "s")))
    bits = F.when(dd.isNull(), 64).when(dd == 0, 1).when(dd < 64, 9).when(dd < 256, 12).when(dd < 2048, 16).otherwise(36)
    changed = lambda c: F.when(at(1, c).isNull(), 64).when(at(1, c) == at(2, c), 1).otherwise(13 + F.length(F.bin(at(1, c).bitwiseXOR(at(2, c)))))
    said = F.octet_length(F.col("s").cast("string")) + 1 + F.octet_length(F.col("a").cast("string"))
    told = seen.select(bits.alias("bits"), changed("a").alias("one"), changed("b").alias("two"), changed("c").alias("six"), said.alias("said"))
    bits, one, two, six, said = map(F.col, ("bits", "one", "two", "six", "said"))
    return L.compare(told, {"sorted-set": said + L.HASHTABLE + 16, "stream": said + L.STREAM + L.LISTPACK, "hash": said + 2 * L.LISTPACK, "series-raw": F.lit(16.0), "series-integer": (bits + one) / 8, "series-two-decimals": (bits + two) / 8, "series-noise": (bits + six) / 8, "series-and-hourly": (bits + one) / 8 + F.lit(16 / 360)})


#: variants that may answer wrongly or only about, and how
_CAVEATS = {"bloom-1pct": "false positives", "bloom-01pct": "false positives", "cuckoo": "false positives", "hyperloglog": "counts only"}
_IDS = {"uuid-set": "n + 64", "key-per-id": _KEYCOST("n"), "int-set": "8 + 64", "sharded-intset": "8 + 16 / 244.0", "bloom-1pct": "9.5851 / 8", "bloom-01pct": "14.3776 / 8", "cuckoo": "1.6", "hyperloglog": "12304.0 / (SELECT count(*) FROM orders)"}


@query("layout_caveats", f"WITH l AS ({_case('ids', 'SELECT 36 AS n FROM orders', _IDS)}) SELECT variant, bytes, CASE WHEN variant LIKE 'bloom%' OR variant = 'cuckoo' THEN 'false positives' WHEN variant = 'hyperloglog' THEN 'counts only' END AS caveat FROM l")
def layout_caveats(spark, d):
    """The variants with what speaks against each."""
    return L.with_caveats(layout_dedup(spark, d), _CAVEATS).select("variant", "bytes", "caveat")


@query("layout_ratio", f"WITH l AS ({_case('ids', 'SELECT 36 AS n FROM orders', _IDS)}) SELECT (SELECT bytes FROM l WHERE variant = 'uuid-set') AS baseline, arg_min(variant, bytes) AS best, min(bytes) AS bytes, round((SELECT bytes FROM l WHERE variant = 'uuid-set') / min(bytes), 4) AS ratio FROM l WHERE variant NOT LIKE 'bloom%' AND variant NOT IN ('cuckoo', 'hyperloglog')")
def layout_ratio(spark, d):
    """Best and baseline; variants with a caveat (they may answer wrongly) do not count."""
    rows = L.with_caveats(layout_dedup(spark, d), _CAVEATS).where("caveat is null")
    told = rows.agg(F.max(F.when(F.col("variant") == "uuid-set", F.col("bytes"))).alias("baseline"), F.min_by("variant", "bytes").alias("best"), F.min("bytes").alias("bytes"))
    return told.select("baseline", "best", "bytes", F.round(F.col("baseline") / F.col("bytes"), 4).alias("ratio"))


def _dictionary(df, column: str, order: list[str]) -> bytes:
    """From the first rows in order: a dictionary has a fixed size."""
    return C.make_dictionary([bytes(r[0]) for r in df.orderBy(*order).select(F.col(column).cast("binary")).limit(64).collect()])


@measured("layout_compressed_runs")
def layout_compressed_runs(spark, d):
    """Payload bytes of the compressed run layouts, measured."""
    j = table(spark, d, "orders").select("o_orderkey", order_json().alias("j"))
    rows = j.join(_runs(spark, d).select("o_orderkey", RUN.encode(F.struct(*[f.name for f in RUN.fields])).alias("p")), "o_orderkey")
    dj, dp = _dictionary(rows, "j", ["o_orderkey"]), _dictionary(rows, "p", ["o_orderkey"])
    size = F.octet_length
    return L.compare(rows, {"json": size("j"), "msgpack": size(C.msgpack_json(F.col("j"))), "json-zstd": size(C.zstd()(F.col("j"))), "json-dictionary": size(C.deflate_with(dj)(F.col("j"))), "packed": size("p"), "packed-dictionary": size(C.deflate_with(dp)(F.col("p")))})


@measured("layout_compressed_turns")
def layout_compressed_turns(spark, d):
    """Turns one by one and sealed chunks of sixteen, compressed; bytes per turn."""
    from ..operators.buckets import chunks

    rows = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text")
    words = _dictionary(rows, "text", ["conv_id", "turn"])
    size = F.octet_length
    single = rows.agg(F.count("*").alias("n"), F.sum(size("text")).alias("a"), F.sum(size(C.zstd()(F.col("text")))).alias("b"), F.sum(size(C.deflate_with(words)(F.col("text")))).alias("c"))
    sealed = chunks(rows, ["conv_id"], ["turn"], 16).groupBy("conv_id", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("t"))
    packed = sealed.agg(F.sum(size(C.zstd()(F.col("t")))).alias("d"), F.sum(size(C.deflate_with(words)(F.col("t")))).alias("e"))
    names = {"a": "text", "b": "turn-zstd", "c": "turn-dictionary", "d": "chunk-zstd", "e": "chunk-dictionary"}
    return single.crossJoin(packed).select(F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col(k) / F.col("n")).alias("bytes")) for k, v in names.items()])).alias("r")).select("r.*")
