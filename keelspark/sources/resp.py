"""The RESP2 wire format: commands out, replies and command logs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


class Incomplete(Exception):
    """The buffer ends inside a value."""


class ReplyError(Exception):
    """An error that a reply carries; it is a value inside a batch and raised only by `value`."""


def encode(*args: str | bytes | int) -> bytes:
    raw = [a if isinstance(a, bytes) else str(a).encode() for a in args]
    return b"*%d\r\n" % len(raw) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in raw)


def parse(data: bytes, at: int = 0):
    """(value, next position).  Bulk strings are bytes, simple ones text, integers int, null None, errors ReplyError, arrays lists."""
    end = data.find(b"\r\n", at)
    if end < 0:
        raise Incomplete
    kind, head, after = data[at : at + 1], data[at + 1 : end], end + 2
    if kind == b"+":
        return head.decode(), after
    if kind == b"-":
        return ReplyError(head.decode()), after
    if kind == b":":
        return int(head), after
    n = int(head)
    if n < 0:
        return None, after
    if kind == b"$":
        if len(data) < after + n + 2:
            raise Incomplete
        return data[after : after + n], after + n + 2
    if kind == b"*":
        out = []
        for _ in range(n):
            value, after = parse(data, after)
            out.append(value)
        return out, after
    raise ValueError(f"unknown kind {kind!r} at {at}")


def value(reply):
    if isinstance(reply, ReplyError):
        raise reply
    return reply


def command_log(spark: SparkSession, path: str) -> DataFrame:
    """file, position, args of every command in append-only files; a cut last command is left out.  One file is one task's work."""
    types = pa.schema([("file", pa.string()), ("position", pa.int64()), ("args", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows, at, n = [], 0, 0
                while at < len(data):
                    try:
                        args, at = parse(data, at)
                    except Incomplete:
                        break
                    rows.append((name, n, args))
                    n += 1
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pydict(dict(zip(types.names, map(list, zip(*rows)))), schema=types)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(types.names, map(list, zip(*rows)))), schema=types)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, position long, args array<binary>")


def send_batches(df: DataFrame, send: Callable[[list], None], size: int = 1000) -> None:
    """Calls send on the executors with lists of at most `size` rows: a sink with bounded batches."""

    def run(rows: Iterator) -> None:
        held = []
        for row in rows:
            held.append(row)
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(run)
