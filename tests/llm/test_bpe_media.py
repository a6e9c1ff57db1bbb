import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelspark.llm import bpe, media

PATH = bpe.default_path()
CODEC = bpe.codec(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    return t


ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "  \n\n  a　b\x1c c", " \u0085x", " 'll don't I'LL", "1²3٣Ⅷ", "a" * 3000, "\U0001f600é́ " * 40, "ab" * 20, "\x00\x01", "�", "a\r\n\tb  ", "ñ" * 100]


def ids(text):
    return np.frombuffer(CODEC.encode_bytes(text), dtype="<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids
    assert CODEC.decode_bytes(CODEC.encode_bytes(text)).decode() == library.decode(ids(text), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = test_any_text.__dict__.setdefault("t", Tokenizer.from_file(PATH))
    assert ids(text) == t.encode(text, add_special_tokens=False).ids


def test_every_code_point_class(library):
    for lo in range(1, 0x20000, 997):
        text = "".join(f"a{chr(c)}b {chr(c)}" for c in range(lo, lo + 40) if not 0xD800 <= c < 0xE000)
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_both_merges_agree():
    rng = random.Random(2)
    for _ in range(500):
        raw = bytes(rng.choice(b"abcdethinos .,\xc3\xa9\xc3\xa8") for _ in range(rng.randint(2, 30)))
        for fragment in CODEC.fragments(raw):
            assert CODEC.merge(fragment) == CODEC.merge_short(fragment)


def test_cuts_are_forced():
    for token in list(CODEC.ids)[:5000]:
        assert CODEC.fragments(token) == [token]


def test_query(spark):
    rows = [(1, t, "x") for t in ODD] + [(2, None, "x"), (None, "null id", "x"), (3, "long " * 60_000, "x")]
    got = bpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    want = sorted((i is not None, i or 0, len(ids(t or "")), hashlib.sha256(CODEC.encode_bytes(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.token_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_round_trip_of_tables(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t for i, t in enumerate(ODD)} | {99: ""}


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60_000))
def test_container_round_trip(raw):
    data = media.write_container(media.pad(raw))
    (t,) = media.read_container(data)
    assert media.payload(data, t)[: len(raw)] == raw and len(media.payload(data, t)) % 192 == 0
    assert (t.codec, t.handler, t.timescale, t.duration) == ("raw ", "soun", 8000, len(media.pad(raw)))
    assert [data[a : a + n] for a, n in t.key_ranges()] == [media.pad(raw)[k : k + 192] for k in range(0, len(media.pad(raw)), 192 * 16)]


def test_walks_other_forms():
    """Wide boxes, unknown boxes between, samples of differing size, 64-bit offsets, a box to the end of the file."""
    import struct

    box, full = media._box, media._full
    body = b"AAABBBBBC"
    stbl = lambda at: box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(20))), full(b"stts", struct.pack(">5I", 2, 2, 10, 1, 5)), full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">II3I", 0, 3, 3, 5, 1)), full(b"co64", struct.pack(">IQQ", 2, at, at + 8)))
    moov = lambda at: box(b"moov", box(b"free", b"xx"), box(b"trak", box(b"mdia", media._box(b"mdhd", bytes([1, 0, 0, 0]) + struct.pack(">QQIQHH", 0, 0, 50, 25, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), box(b"minf", stbl(at)))))
    wide = struct.pack(">I4sQ", 1, b"skip", 20) + b"abcd"
    lead = wide + moov(0)
    data = wide + moov(len(lead) + 8) + struct.pack(">I4s", 0, b"mdat") + body
    (t,) = media.read_container(data)
    assert media.payload(data, t) == body and t.duration == 25 and t.timescale == 50 and t.codec == "mp4a" and len(t.keys) == 3
    with pytest.raises(ValueError):
        list(media.boxes(struct.pack(">I4s", 99, b"moov")))


def test_media_query(spark):
    rows = [(1, ""), (2, None), (3, "x"), (4, "é" * 96), (5, "y" * 192), (6, "z" * 50_000), (None, "x")]
    got = {r.doc_id: r for r in media.media_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == len(media.write_container(p)) and r.media_sha256 == hashlib.sha256(media.write_container(p)).hexdigest()
    assert got[1][1:] == got[2][1:] and got[3][1:] == got[None][1:]
    stored = {r.doc_id: r for r in media.store(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(k.length == 192 for r in stored.values() for k in r.keyframes)
