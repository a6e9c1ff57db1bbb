"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, for each role, what opens and closes a turn and whether its text counts for the loss.  The machine walks a
conversation's turns in order, says where the order of roles is broken, and emits text segments, each with a loss flag.  Inside texts and
roles every control string of the template gets an escape after its first character and every escape is doubled, so no text can open or
close a turn and reading back is exact: `Reader` takes the formatted text alone.

A conversation is streamed: rows are dealt by conv_id and sorted inside the partition, digests run along, and memory holds one batch and one
turn, however many turns a conversation has.

Defined results: null text and null role are empty; rows sort by turn (null first), role, text, and repeated rows stay; rows
with a null conv_id are one conversation; a broken order of roles is told in the column valid and formatted all the same; no rows, no result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What marks turns.  `open` stands before the role, `mid` between role and text, `close` after the text."""

    open: str = "<|im_start|>"
    mid: str = "\n"
    close: str = "<|im_end|>"
    after: str = "\n"
    loss: frozenset = frozenset({"assistant"})
    #: more strings that models take as control strings; escaped in texts like the template's own
    controls: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    #: role -> roles that may follow; "" is the start, a conversation may end after the roles in `ends`
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}, hash=False)
    ends: frozenset = frozenset({"user", "assistant"})

    def __post_init__(self):
        for mark in (self.open, self.close):
            if any(mark.startswith(mark[i:]) for i in range(1, len(mark))) or ESCAPE in mark:
                raise ValueError(f"{mark!r} can overlap itself or holds the escape")

    @property
    def guarded(self) -> tuple:
        return (self.open, self.close, *self.controls)


CHAT = Template()


def escaper(template: Template) -> re.Pattern:
    return re.compile("(?=" + "|".join(map(re.escape, template.guarded)) + ")(.)", re.S)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[1] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def segments(role: str, text: str, template: Template = CHAT, pattern: re.Pattern | None = None) -> list[tuple[str, bool]]:
    """The segments of one turn with their loss flags.  A line end inside a role is kept apart from the one after it by an escape."""
    pattern = pattern or escaper(template)
    name = escape(role, pattern).replace(template.mid, ESCAPE * 3 + template.mid) if template.mid in role else escape(role, pattern)
    return [(template.open + name + template.mid, False), (escape(text, pattern), role in template.loss), (template.close + template.after, False)]


class Reader:
    """Turns from formatted text, fed piece by piece."""

    def __init__(self, template: Template = CHAT):
        self.template, self.rest = template, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        t = self.template
        self.rest += piece
        while (end := self.rest.find(t.close + t.after)) >= 0:
            turn, self.rest = self.rest[len(t.open) : end], self.rest[end + len(t.close + t.after) :]
            at = turn.find(t.mid)
            while turn[max(0, at - 3) : at] == ESCAPE * 3:
                at = turn.find(t.mid, at + 1)
            role = turn[:at].replace(ESCAPE * 3 + t.mid, t.mid)
            yield unescape(role), unescape(turn[at + len(t.mid) :])


class Machine:
    """The order of roles."""

    def __init__(self, template: Template = CHAT):
        self.template, self.state, self.valid = template, "", True

    def step(self, role: str) -> bool:
        ok = role in self.template.follows.get(self.state, ())
        self.valid &= ok
        self.state = role
        return ok

    def finish(self) -> bool:
        return self.valid and self.state in self.template.ends


class _Conversation:
    def __init__(self, conv_id, template: Template):
        self.conv_id, self.template = conv_id, template
        self.machine, self.reader = Machine(template), Reader(template)
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str, text: str, pattern: re.Pattern) -> None:
        self.machine.step(role)
        made = segments(role, text, self.template, pattern)
        for piece, flag in made:
            self.chars += len(piece)
            if flag:
                own = unescape(piece)
                self.loss_chars += len(own)
                self.loss.update(own.encode())
        for back_role, back_text in self.reader.feed("".join(p for p, _ in made)):
            self.n += 1
            self.turns.update(f"{back_role}\n{back_text}\n".encode())

    def row(self) -> tuple:
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.machine.finish())


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
_TYPES = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def format_digests(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per conversation, read back from the formatted text."""
    common.prepare(conversations.sparkSession)

    def run(batches):
        now, done, pattern = None, [], escaper(template)

        def table():
            return pa.RecordBatch.from_pydict(dict(zip(_TYPES.names, map(list, zip(*done)))), schema=_TYPES)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv, template)
                now.add(role, text, pattern)
            if done:
                yield table()
                done = []
        if now is not None:
            done = [now.row()]
            yield table()

    return _sorted(conversations).mapInArrow(run, _DDL)


def format_segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, position, segment, loss, valid_so_far: the formatted text as segments, in order."""
    common.prepare(conversations.sparkSession)
    types = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_()), ("valid_so_far", pa.bool_())])

    def run(batches):
        conv, machine, position, pattern = object(), None, 0, escaper(template)
        for batch in batches:
            rows = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if machine is None or c != conv:
                    conv, machine, position = c, Machine(template), 0
                machine.step(role)
                for piece, flag in segments(role, text, template, pattern):
                    rows.append((c, position, piece, flag, machine.valid))
                    position += 1
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(types.names, map(list, zip(*rows)))), schema=types)

    return _sorted(conversations).mapInArrow(run, "conv_id long, position long, segment string, loss boolean, valid_so_far boolean")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns say a control sequence of another template."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
