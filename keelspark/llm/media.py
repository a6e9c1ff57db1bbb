"""Media columns: ISO media containers written, walked and described without decoding their payload.

write_container lays a payload down as 8-bit samples: ftyp, moov (mvhd, trak, mdia, minf, stbl) and mdat.  A media sample is a frame of
192 bytes, every sixteenth of them a sync sample, sixty-four to a chunk.  read_container walks the nested boxes of any such file,
decodes the sample tables (stsd, stts, stsc, stsz, stco or co64, stss) and yields codec, duration and the byte ranges of the key frames;
payload() gathers the sample bytes from those tables alone.  Every row is independent: no shuffle.

Defined results: null is the empty text, which gives one frame of spaces; equal texts give equal values; broken containers raise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

FRAME, PER_CHUNK, SYNC_EVERY, RATE = 192, 64, 16, 8000
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return (struct.pack(">I", size) + kind if size < 1 << 32 else struct.pack(">I", 1) + kind + struct.pack(">Q", size + 8)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(raw: bytes) -> bytes:
    """raw with spaces appended up to a positive multiple of the frame."""
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def write_container(payload: bytes) -> bytes:
    n = len(payload) // FRAME
    chunks, last = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * bool(chunks) + [(chunks + 1, last)] * bool(last)
    duration = n * FRAME
    wide = len(payload) > 0xF0000000
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    sync = np.arange(1, n + 1, SYNC_EVERY, dtype=">u4")

    def head(start: int) -> bytes:
        offsets = start + FRAME * PER_CHUNK * np.arange(chunks + bool(last), dtype=np.int64)
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, FRAME)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, count, 1) for first, count in runs)),
            _full(b"stsz", struct.pack(">II", FRAME, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration & 0xFFFFFFFF, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration & 0xFFFFFFFF, 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7), media)
        movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, duration & 0xFFFFFFFF, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41") + _box(b"moov", movie, track)

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    return head(len(head(0)) + lead) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None):
    """(path, first byte of the body, end) of every box, nested ones after their parent."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (kind,), body, stop
        if kind in _NESTED:
            for path, a, b in boxes(data, body, stop):
                yield (kind, *path), a, b
        start = stop


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 1
    duration: int = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None

    @property
    def seconds(self) -> float:
        return self.duration / max(self.timescale, 1)

    def key_ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of each key frame."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))


def read_container(data: bytes) -> list[Track]:
    """The tracks, from the boxes and sample tables alone."""
    tracks: list[Track] = []
    raw: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in boxes(data):
        if path[-1] == b"trak":
            raw.append({})
        elif raw and path[:2] == (b"moov", b"trak"):
            raw[-1][path[-1]] = (a, b)
    for found in raw:
        t = Track()

        def rows(kind: bytes, form: str, found=found) -> np.ndarray:
            a, _ = found[kind]
            (n,) = struct.unpack_from(">I", data, a + 4)
            return np.frombuffer(data, dtype=form, count=n, offset=a + 8)

        t.codec = data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16].decode("latin-1")
        t.handler = data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12].decode("latin-1")
        a = found[b"mdhd"][0]
        t.timescale, _ = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        a = found[b"stsz"][0]
        size, n = struct.unpack_from(">II", data, a + 4)
        t.sizes = np.full(n, size, dtype=np.int64) if size else np.frombuffer(data, dtype=">u4", count=n, offset=a + 12).astype(np.int64)
        stts = rows(b"stts", ">u4,>u4")
        t.duration = int((stts["f0"].astype(np.int64) * stts["f1"].astype(np.int64)).sum())
        chunk_at = (rows(b"co64", ">u8") if b"co64" in found else rows(b"stco", ">u4")).astype(np.int64)
        stsc = rows(b"stsc", ">u4,>u4,>u4")
        first = np.append(stsc["f0"].astype(np.int64), len(chunk_at) + 1)
        per = np.repeat(stsc["f1"].astype(np.int64), np.diff(first))
        begin = np.cumsum(per) - per
        before = np.concatenate([[0], np.cumsum(t.sizes)])
        t.offsets = (np.repeat(chunk_at - before[begin], per) + before[:-1])[:n]
        t.keys = rows(b"stss", ">u4").astype(np.int64) - 1 if b"stss" in found else np.arange(n)
        tracks.append(t)
    return tracks


def payload(data: bytes, track: Track) -> bytes:
    """The sample bytes, gathered run by run."""
    if not len(track.offsets):
        return b""
    ends = track.offsets + track.sizes
    cut = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[np.append(0, cut)].tolist(), ends[np.append(cut - 1, len(ends) - 1)].tolist()))


def feature(track: Track) -> str:
    ranges = track.key_ranges()
    told = zlib.crc32(np.array(ranges, dtype="<i8").tobytes())
    return f"{track.codec.strip()};{track.handler};rate={track.timescale};duration={track.duration};frames={len(track.sizes)};keys={len(ranges)};first={ranges[0][0]}+{ranges[0][1]};last={ranges[-1][0]}+{ranges[-1][1]};ranges={told:08x}"


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes long"
_TYPES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
    + [("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("keyframes", pa.int64())]
)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every whole text in a container, reads it back and describes it."""
    common.prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for raw in common.utf8(batch.column("text")):
            data = write_container(pad(raw))
            (track,) = read_container(data)
            back = payload(data, track)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec.strip(), track.seconds, len(track.keys)))
        return {"doc_id": batch.column("doc_id")} | dict(zip(_TYPES.names[1:], zip(*rows)))

    return common.map_batches(common.text_of(docs), run, _SCHEMA, _TYPES)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media (the container) and its key frames as an array of (offset, length)."""
    common.prepare(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        made = [write_container(pad(raw)) for raw in common.utf8(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "media": made, "keyframes": [[{"offset": a, "length": n} for a, n in read_container(m)[0].key_ranges()] for m in made]}

    return common.map_batches(common.text_of(docs), run, "doc_id long, media binary, keyframes array<struct<offset: long, length: long>>", arrow)
