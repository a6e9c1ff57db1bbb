"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over, so a text piece is cut there and
the fragments are encoded independently.  The merges of a fragment depend on that fragment alone, hence its ids are remembered in a
bounded table and a text costs little more than one pattern pass.  Each row is independent: no shuffle, bounded memory.

Defined results: null and empty texts give no ids; a text may have any length (long fragments merge with a heap, n log n); the string
of an added special token inside a text becomes that token, as the vocabulary file asks; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: The byte-level split of the public vocabulary (a fixed value of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """piece -> ids as little-endian 32-bit integers; emptied when full."""

    def __init__(self, codec: ForcedBoundaryBPE, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, piece: str) -> bytes:
        out = self.codec.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


class ForcedBoundaryBPE:
    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _byte_alphabet()
        raw = {token: bytes(back[c] for c in token) for token in spec["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in spec["model"]["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[self.ids[raw[a]], self.ids[raw[b]]] = (rank, self.ids[raw[a] + raw[b]])
        self.first = [self.ids[bytes([b])] for b in range(256)]
        inside = np.zeros((256, 256), dtype=bool)
        for token in self.ids:
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        #: pairs of bytes between which a cut is certain; the same as one flag byte per pair, for short pieces
        self.forced = ~inside
        self.flags = self.forced.tobytes()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        self.memo = _Memo(self, memo)

    def fragments(self, piece: bytes) -> list[bytes]:
        """piece cut at every forced boundary."""
        if len(piece) < 2:
            return [piece]
        if len(piece) < 48:
            flags = self.flags
            cuts = [i for i, (a, b) in enumerate(zip(piece, piece[1:]), 1) if flags[a << 8 | b]]
            if not cuts:
                return [piece]
        else:
            b = np.frombuffer(piece, dtype=np.uint8)
            cuts = (np.flatnonzero(self.forced[b[:-1], b[1:]]) + 1).tolist()
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])]

    def encode_piece(self, piece: bytes) -> bytes:
        ids: list[int] = []
        for fragment in self.fragments(piece):
            ids += self.merge_short(fragment) if len(fragment) < 32 else self.merge(fragment)
        return array("I", ids).tobytes() if array("I").itemsize == 4 and sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()

    def merge_short(self, fragment: bytes) -> list[int]:
        """The same merges by looking for the lowest rank again and again; a rank that occurs twice is merged from the left."""
        ids = [self.first[b] for b in fragment]
        get, none = self.merges.get, (1 << 30, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
        return ids

    def merge(self, fragment: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, on a linked list with a heap."""
        ids = [self.first[b] for b in fragment]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        known = self.merges
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := known.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := known.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := known.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        memo, find = self.memo, self.find
        if self.split_added is None or not any(s in text for s in self.added):
            return b"".join([memo[p] for p in find(text)])
        out = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [self.added[part].to_bytes(4, "little")] if k % 2 else [memo[p] for p in find(part)]
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The decoded text as UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


_CODECS: dict[str, ForcedBoundaryBPE] = {}


def codec(path: str) -> ForcedBoundaryBPE:
    """One codec per worker and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = ForcedBoundaryBPE(path)
    return _CODECS[path]


_TYPES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    common.prepare(docs.sparkSession)
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        c, out = codec(path), ([], [], [])
        for text in batch.column("text").to_pylist():
            ids = c.encode_bytes(text or "")
            out[0].append(len(ids) // 4)
            out[1].append(hashlib.sha256(ids).hexdigest())
            out[2].append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": out[0], "ids_sha256": out[1], "decoded_sha256": out[2]}

    return common.map_batches(common.text_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _TYPES)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int): the tokens themselves."""
    common.prepare(docs.sparkSession)
    path = path or default_path()
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        c = codec(path)
        return {"doc_id": batch.column("doc_id"), "ids": [np.frombuffer(c.encode_bytes(t or ""), dtype="<u4").astype(np.int32) for t in batch.column("text").to_pylist()]}

    return common.map_batches(common.text_of(docs), run, "doc_id long, ids array<int>", arrow)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    common.prepare(tokens.sparkSession)
    path = path or default_path()
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        c = codec(path)
        return {"doc_id": batch.column("doc_id"), "text": [c.decode_bytes(np.array(x or [], dtype="<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]}

    return common.map_batches(tokens.select("doc_id", "ids"), run, "doc_id long, text string", arrow)
