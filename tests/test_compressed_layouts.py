"""The measured bytes of the compressed layouts against zlib, zstd and MessagePack on plain Python values."""

import json
import zlib

import zstandard

import __spark_entry__
from keelspark.plans.records import RUN, F, _runs


def deflated(words, raw):
    c = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_DEFAULT_STRATEGY, words)
    return len(c.compress(raw) + c.flush())


def zstd(raw):
    return len(zstandard.ZstdCompressor(level=6).compress(raw))


def msgpack(value):
    """The bytes of a flat value, by the format's document."""
    if isinstance(value, dict):
        return 1 + sum(msgpack(k) + msgpack(v) for k, v in value.items())
    if isinstance(value, str):
        n = len(value.encode())
        return n + (1 if n < 32 else 2)
    return next(size for most, size in ((1 << 7, 1), (1 << 8, 2), (1 << 16, 3), (1 << 32, 5), (1 << 64, 9)) if 0 <= value < most)


def test_runs(spark, sf):
    orders = sorted(spark.read.parquet(f"{sf}/orders.parquet").collect(), key=lambda r: r.o_orderkey)
    texts = [json.dumps({"o_orderkey": r.o_orderkey, "o_custkey": r.o_custkey, "o_orderstatus": r.o_orderstatus, "o_orderdate": f"{r.o_orderdate:%Y-%m-%d}", "o_orderpriority": r.o_orderpriority, "cents": round(r.o_totalprice * 100)}, separators=(",", ":")).encode() for r in orders]
    packed = [bytes(r.p) for r in sorted(_runs(spark, sf).select("o_orderkey", RUN.encode(F.struct(*[f.name for f in RUN.fields])).alias("p")).collect(), key=lambda r: r.o_orderkey)]
    dj, dp = (b"".join(x[:64])[-32768:] for x in (texts, packed))
    want = {"json": sum(map(len, texts)), "msgpack": sum(msgpack(json.loads(t)) for t in texts), "json-zstd": sum(map(zstd, texts)), "json-dictionary": sum(deflated(dj, t) for t in texts), "packed": sum(map(len, packed)), "packed-dictionary": sum(deflated(dp, p) for p in packed)}
    got = {r.variant: (r.records, r.bytes, r.ratio) for r in __spark_entry__.queries()["layout_compressed_runs"](spark, sf).collect()}
    n = len(orders)
    assert got.keys() == want.keys()
    for name, size in want.items():
        records, each, ratio = got[name]
        assert records == n and abs(each - size / n) < 1e-4 and abs(ratio - want["json"] / size) < 1e-4, name


def test_turns(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t} of conversation {c}: " + "words and more words " * (t % 5)) for c in range(5) for t in range(20 + c)] + [(9, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    texts = {(c, t): x.encode() for c, t, _, x in rows if x is not None}
    words = b"".join(texts[k] for k in sorted(texts)[:64])[-32768:]
    chunks = [b"\n".join(texts[k] for k in sorted(texts) if k[0] == c and a <= k[1] < a + 16) for c in range(5) for a in (0, 16)]
    one = list(texts.values())
    want = {"text": sum(map(len, one)), "turn-zstd": sum(map(zstd, one)), "turn-dictionary": sum(deflated(words, t) for t in one), "chunk-zstd": sum(map(zstd, chunks)), "chunk-dictionary": sum(deflated(words, t) for t in chunks)}
    got = {r.variant: r.bytes for r in __spark_entry__.queries()["layout_compressed_turns"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v / len(one)) < 1e-9 for k, v in want.items())
