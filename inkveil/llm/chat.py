"""Conversations as training text with a loss mask, by a finite-state machine over roles.

A ``Template`` declares the marks around a turn, the roles under loss, and the machine: which role may
follow in which state, and the state it leads to. The machine reads a conversation turn by turn; each turn
moves it and emits three segments: the opening with the role, the text, the closing. Only texts of roles
under loss carry a loss flag. A turn that the state doesn't allow is noted and emitted all the same, and the
machine goes on in the state that its role leads to from the start (or stays, if the start doesn't know it).

Control strings are never found inside what turns say: after their first character a backslash is put in, and
backslashes are doubled, which ``unescaped`` takes back. So whatever a text holds, a turn ends at the first
closing mark, and ``turns`` reads the formatted text alone.

Conversations are dealt out by id and sorted by turn; a task reads its rows in order and holds one chunk. A row of
the result holds whole turns, some ``CHUNK`` characters at most unless a turn alone is longer, so nearly every
conversation is one row, and one of any length is several, in order of ``chunk``. What a conversation is depends
on the turns before, so each is read by one task from its first turn to its last.

Defined results: null roles and texts are empty ones; turns with the same number, or without one (these come first),
go by role and text, so repeated rows are turns of their own. A null id is one conversation. Unknown roles are formatted,
without loss, and aren't allowed by the machine. An empty table has no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 1 << 20
_ROWS = 1024


@dataclass(frozen=True)
class Template:
    """A turn is ``opening``, role, ``middle``, text, ``closing``. Marks hold no backslash and two characters at least."""

    opening: str = "### "
    middle: str = ": "
    closing: str = "</turn>\n"
    #: Strings that no text may hold as they are: the marks, without the white space around them.
    control: tuple[str, ...] = ("###", "</turn>")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    #: (state, role) to state; the states in ``ends`` may end a conversation.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    ends: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        for mark in (self.middle, *self.control):
            if len(mark) < 2 or "\\" in mark:
                raise ValueError(f"control string {mark!r}")
        for mark in (self.opening, self.closing):
            if not any(c in mark for c in self.control):
                raise ValueError(f"{mark!r} holds no control string")

    def escaped(self, text: str, role: bool = False) -> str:
        marks = [*self.control, self.middle] if role else self.control
        return re.sub("|".join([r"\\", *(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in marks)]), r"\g<0>\\", text)

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        """Roles and texts, read back from formatted turns."""
        at = 0
        while at < len(text):
            end = text.index(self.closing, at)
            if not text.startswith(self.opening, at):
                raise ValueError(f"no turn begins at {at}")
            role, said = text[at + len(self.opening) : end].split(self.middle, 1)
            yield unescaped(role), unescaped(said)
            at = end + len(self.closing)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Machine:
    """Formats the turns of one conversation, a chunk at a time."""

    def __init__(self, template: Template):
        self.template, self.state, self.n, self.bad = template, template.start, 0, None
        self.chunk = 0
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.segments, self.length, self.n_turns = [], [], 0, 0

    def turn(self, role: str, text: str) -> None:
        t = self.template
        after = t.moves.get((self.state, role))
        if after is None:
            self.bad = self.n if self.bad is None else self.bad
            after = t.moves.get((t.start, role), self.state)
        self.state, self.n, self.n_turns = after, self.n + 1, self.n_turns + 1
        for piece, loss in (
            (t.opening + t.escaped(role, role=True) + t.middle, False),
            (t.escaped(text), role in t.loss),
            (t.closing, False),
        ):
            self.pieces.append(piece)
            self.segments.append({"start": self.length, "end": self.length + len(piece), "loss": loss})
            self.length += len(piece)

    def taken(self, last: bool) -> tuple:
        """The chunk so far: number, text, segments, turns, and whether the conversation ends here in order."""
        bad = self.n if last and self.bad is None and self.state not in self.template.ends else self.bad
        out = (self.chunk, "".join(self.pieces), self.segments, self.n_turns, last, bad)
        self.chunk += 1
        self._clear()
        return out


_FORMATTED = "chunk int, text string, segments array<struct<start:int,end:int,loss:boolean>>, n_turns int, last boolean, bad_turn int"
_SEGMENTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())]))
_TYPES = [pa.int32(), pa.string(), _SEGMENTS, pa.int32(), pa.bool_(), pa.int32()]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind = ["id", "chunk", "text", "segments", "n_turns", "last", "bad_turn"], None
        out, size, conv, machine = [], 0, None, None
        for batch in batches:
            kind = kind or batch.column("id").type
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                for id_, role, text in zip(*(part.column(c).to_pylist() for c in ("id", "role", "text")), strict=True):
                    if machine is None or id_ != conv:
                        if machine is not None:
                            out.append((conv, *machine.taken(True)))
                        conv, machine = id_, Machine(template)
                    elif machine.length + len(text) > CHUNK:
                        out.append((conv, *machine.taken(False)))
                    machine.turn(role, text)
                    size += len(text)
                    if out and size > CHUNK:
                        yield _batch(out, names, [kind, *_TYPES])
                        out, size = [], machine.length
        if machine is not None:
            yield _batch([*out, (conv, *machine.taken(True))], names, [kind, *_TYPES])

    return run


def formatted(
    conversations: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``id, chunk, text, segments, n_turns, last, bad_turn``, all rows of a conversation one after the other in one task.

    ``segments`` cut the whole text of the row, in code points. ``bad_turn`` is the first turn, from 0, that the
    machine didn't allow so far (on the last row, the number of turns if it may not end there), else null.
    """
    rows = conversations.select(
        F.col(conv).alias("id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text")))
    )
    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string(_FORMATTED).fields])
    return dealt.mapInArrow(_format(template), schema)


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        n = chars = loss_chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            types = [batch.column("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            out = []
            for row in batch.to_pylist():
                text = row["text"]
                for role, said in template.turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for s in row["segments"]:
                    if s["loss"]:
                        said = unescaped(text[s["start"] : s["end"]])
                        loss_chars += len(said)
                        loss.update(said.encode())
                chars += len(text)
                if row["last"]:
                    out.append((row["id"], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, row["bad_turn"] is None))
                    n = chars = loss_chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            yield _batch(out, names, types)

    return run


def read_back(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, from the texts and masks of ``formatted``: turns, what is under loss, and lengths."""
    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    full = T.StructType([texts.schema["id"], *T._parse_datatype_string(schema).fields])
    return texts.mapInArrow(_digests(template), full)


def control_case(conversations: DataFrame, number: int = -7) -> DataFrame:
    """The columns read here, and one more conversation whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    more = conversations.sparkSession.createDataFrame([(number, i, r, said) for i, r in enumerate(("user", "assistant"))], "c long, t long, r string, x string")
    own = conversations.select("conv_id", "turn", "role", "text")
    kinds = [F.col(a).cast(own.schema[b].dataType).alias(b) for a, b in zip(more.columns, own.columns, strict=True)]
    return own.unionByName(more.select(*kinds))
