"""Chat formatting with a grammar that is read back.

    conversation := "<s>" turn*
    turn         := "[INST] " text " [/INST]"                 user
                  | "[SYS] " text " [/SYS]"                   system
                  | "[OUT] " text " </s>"                     assistant
                  | "[ROLE] " role " [TEXT] " text " [/ROLE]"  any other role

A control string counts unless a backslash stands before it; the parser takes one backslash
away from before an escaped one. Each turn is rendered as it is, parsed, and compared with
its source; if the two differ, one backslash is put before each control string in its text,
and it is parsed and compared again. Only texts that conflict are changed.

Conversations are streams: turns are sorted inside a partition, and renderer and parser hold
one turn at a time, so a conversation of any length needs bounded memory.

Defined cases. Null text or role: empty. Null conv_id: a conversation of its own. Turns of
one number: by role, then text; repeated rows are turns of their own. Empty table: empty
result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "<s>"
OPEN = {"user": "[INST]", "system": "[SYS]", "assistant": "[OUT]"}
CLOSE = {"user": "[/INST]", "system": "[/SYS]", "assistant": "</s>"}
CONTROLS = (START, *OPEN.values(), *CLOSE.values(), "[ROLE]", "[TEXT]", "[/ROLE]")
_ANY = "|".join(map(re.escape, CONTROLS))
_CONTROL = re.compile(rf"(\\*)({_ANY})")
LONGEST = max(map(len, CONTROLS))


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    """Takes one backslash from before each control string that has any."""
    return _CONTROL.sub(lambda m: (m[1][1:] if m[1] else "") + m[2], text)


class GrammarError(ValueError):
    pass


class Parser:
    """Reads a conversation in pieces of any size; ``feed`` gives the turns completed."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        turns = []
        if not self.begun:
            if len(self.rest) < len(START):
                return []
            if not self.rest.startswith(START):
                raise GrammarError("a conversation begins with " + START)
            self.rest, self.begun = self.rest[len(START) :], True
        while (got := self._turn()) is not None:
            turns.append(got[:2])
            self.rest = self.rest[got[2] :]
        return turns

    def _until(self, at: int, control: str) -> tuple[str, int] | None:
        """The text up to a blank and an unescaped ``control``, and where it ends."""
        for m in _CONTROL.finditer(self.rest, at):
            if m[1]:
                continue
            if m[2] != control or m.start() <= at or self.rest[m.start() - 1] != " ":
                raise GrammarError(f"{m[2]} where {control} is due")
            return unescape(self.rest[at : m.start() - 1]), m.end()
        return None

    def _turn(self) -> tuple[str, str, int] | None:
        for role, mark in OPEN.items():
            if self.rest.startswith(mark + " "):
                got = self._until(len(mark) + 1, CLOSE[role])
                return got and (role, *got)
        if self.rest.startswith("[ROLE] "):
            name = self._until(len("[ROLE] "), "[TEXT]")
            got = name and self._until(name[1] + 1, "[/ROLE]")
            return got and (name[0], *got)
        if len(self.rest) > LONGEST:
            raise GrammarError("no turn begins here")
        return None

    def close(self) -> None:
        if self.rest or not self.begun:
            raise GrammarError("the conversation breaks off")


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it. Parsing it gives the source."""
    name = role
    for level in range(3):
        body = escape(text) if level else text
        if role in OPEN:
            head, tail = f"{OPEN[role]} ", f" {CLOSE[role]}"
        else:
            name = escape(role) if level else role
            head, tail = f"[ROLE] {name} [TEXT] ", " [/ROLE]"
        out = head + body + tail
        if level < 2:
            try:
                parser = Parser()
                turns = parser.feed(START + out)
                parser.close()
            except GrammarError:
                continue
            if turns == [(role, text)]:
                return out, len(head), len(head) + len(body)
    raise GrammarError("a turn does not come back as it was")


FORMATTED_SCHEMA = "conv_id bigint, position bigint, piece string, loss_start bigint, loss_end bigint"


_FORMATTED = {"conv_id": pa.int64(), "position": pa.int64(), "piece": pa.string(), "loss_start": pa.int64(), "loss_end": pa.int64()}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn, each conversation's rows in order in one partition. Joined in that
    order the pieces are the formatted conversation; ``loss_start`` to ``loss_end`` (offsets
    in it) is under the loss mask: assistants' texts. Both are null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = object(), 0, 0
        for batch in batches:
            rows = []
            for conv, missing, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, prefix = None if missing else conv, ""
                if conv != now:
                    now, position, at, prefix = conv, 0, 0, START
                piece, low, high = render(role, text)
                at += len(prefix)
                mask = (at + low, at + high) if role == "assistant" else (None, None)
                rows.append((conv, position, prefix + piece, *mask))
                position, at = position + 1, at + len(piece)
            yield _batch(rows, _FORMATTED)

    empty = F.lit("")
    rows = conversations.select(
        F.coalesce("conv_id", F.lit(0)).cast("bigint").alias("conv_id"),
        F.col("conv_id").isNull().alias("missing"),
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    order = ["conv_id", "missing", "turn", "role", "text"]
    rows = rows.repartition("conv_id", "missing").sortWithinPartitions(*order)
    return rows.drop("turn").mapInArrow(run, FORMATTED_SCHEMA)


DIGEST_SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


_DIGEST = {
    "conv_id": pa.int64(),
    "n_turns": pa.int64(),
    "turns_sha256": pa.string(),
    "loss_chars": pa.int64(),
    "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(),
}


class _Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.parser = conv, Parser()
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, low: int | None, high: int | None) -> None:
        for role, text in self.parser.feed(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if low is not None:
            text = unescape(piece[low - self.chars : high - self.chars])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        self.parser.close()
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses what ``format_turns`` gave and digests, per conversation, the turns found and
    the unescaped text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            rows = []
            for conv, position, piece, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if now:
                        rows.append(now.row())
                    now = _Digest(conv)
                now.add(piece, low, high)
            yield _batch(rows, _DIGEST)
        if now:
            yield _batch([now.row()], _DIGEST)

    return formatted.mapInArrow(run, DIGEST_SCHEMA)
