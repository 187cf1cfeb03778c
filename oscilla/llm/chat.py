"""Chat formatting by a state machine over roles and a declarative template.

A template names, for each role, the marks before and after a text and whether the text is learnt; one
more entry serves every other role, whose name is written as a text of its own.  Marks are made of
control strings.  A control string inside a text gets a backslash after its first character, and one more
if it has some already, so unescaping gives back every text, also one that holds escaped strings.

Rows are sorted by conversation and turn inside partitions and pass through as a stream: one segment for
each mark and text, with a loss flag, and the state of the machine after the turn.  Reading back walks the
segments of a conversation in their order, joins marks and texts, finds the control strings, unescapes and
hashes as it goes.  Neither step holds a conversation, so one of any length takes no more memory than a
batch; a conversation is read by one task, as its digest is one sequence.

Cases: a null text is empty, a null role is the empty role.  Turns come in the order of ``turn`` (null
first), then role, then text.  Rows that repeat a turn are turns of their own.  All conversations are formatted, also those
whose turns break the order (``valid`` is false from there on); a null conversation is one as well.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id {kind}, turn_no int, segment int, part string, text string, loss boolean, valid boolean, complete boolean"
SPOKEN = "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean"


@dataclass(frozen=True)
class Template:
    """Marks (before, after, learnt) of each role, and the orders in which roles may speak."""

    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", "</s>", True)}
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", "</s>")  # before the role's name, between, after
    start: str = "<s>"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered",)

    def control(self) -> list[str]:
        marks = [self.start, *self.other, *(m for before, after, _ in self.roles.values() for m in (before, after))]
        return sorted({m.strip() for m in marks} - {""})

    def __post_init__(self) -> None:
        """Control strings have two characters or more, and inside none of them another begins."""
        control = self.control()
        heads = {c[0] for c in control}
        if any(len(c) < 2 or heads & set(c[1:]) or "\\" in c for c in control):
            raise ValueError("control strings must not hold the first character of one after their own")


class Escape:
    """Makes control strings inside texts harmless, and back."""

    def __init__(self, control: list[str]) -> None:
        self.heads = {c[0] for c in control}
        self.plain = re.compile("|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in control))
        self.escaped = re.compile("|".join(re.escape(c[0]) + r"\\(?=\\*" + re.escape(c[1:]) + ")" for c in control))

    def hide(self, text: str) -> str:
        return self.plain.sub(lambda m: m[0] + "\\", text) if any(h in text for h in self.heads) else text

    def show(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[0][0], text) if "\\" in text else text


def segments_of(template: Template, escape: Escape, role: str, text: str, first: bool) -> list[tuple[str, str, bool]]:
    """(part, text, loss) of one turn."""
    opening = template.start if first else ""
    if role in template.roles:
        before, after, learnt = template.roles[role]
        return [("mark", opening + before, False), ("text", escape.hide(text), learnt), ("mark", after, False)]
    before, between, after = template.other
    return [
        ("mark", opening + before, False),
        ("role", escape.hide(role), False),
        ("mark", between, False),
        ("text", escape.hide(text), False),
        ("mark", after, False),
    ]


def format_conversations(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments of all conversations, each conversation whole and in order within its partition."""
    template = template or Template()
    escape = Escape(template.control())
    kind = turns.schema[conv].dataType.simpleString()
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, number, segment, begun = None, "start", 0, 0, False
        for batch in batches:
            out: list[tuple] = []
            for c, r, t in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if not begun or c != last:
                    last, state, number, segment, begun = c, "start", 0, 0, True
                state = template.moves.get(state, {}).get(r, "broken")
                for part, piece, loss in segments_of(template, escape, r, t, number == 0):
                    out.append((c, number, segment, part, piece, loss, state != "broken", state in template.ends))
                    segment += 1
                number += 1
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field("conv_id").type), *(pa.array(x, y) for x, y in zip(columns[1:], KINDS, strict=True))],
                    NAMES,
                )

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, SEGMENTS.format(kind=kind))


NAMES = ["conv_id", "turn_no", "segment", "part", "text", "loss", "valid", "complete"]
KINDS = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]


class Reader:
    """Reads one conversation from its formatted text, given piece by piece, and digests it."""

    def __init__(self, template: Template, escape: Escape) -> None:
        self.template, self.escape = template, escape
        self.by_mark = {before.strip(): (name, before, after) for name, (before, after, _) in template.roles.items()}
        self.control = re.compile("|".join(map(re.escape, template.control())))
        self.turns, self.chars, self.digest, self.left = 0, 0, hashlib.sha256(), ""

    def feed(self, piece: str) -> None:
        """Add formatted text; every turn that ends in it is read."""
        self.chars += len(piece)
        self.left += piece
        at = len(self.template.start) if not self.turns and self.left.startswith(self.template.start) else 0
        while (step := self.turn(at)) is not None:
            at = step
        if self.turns:
            self.left = self.left[at:]

    def turn(self, at: int) -> int | None:
        """Read the turn that begins at ``at``; its end, or None if it isn't there yet."""
        opened = self.control.match(self.left, at)
        if opened is None:
            return None
        if opened[0] in self.by_mark:
            role, before, after = self.by_mark[opened[0]]
            start = at + len(before)
        else:
            before, between, after = self.template.other
            end = self.find(between, at + len(before))
            if end is None:
                return None
            role, start = self.escape.show(self.left[at + len(before) : end]), end + len(between)
        end = self.find(after, start)
        if end is None:
            return None
        self.turns += 1
        self.digest.update(f"{role}\n{self.escape.show(self.left[start:end])}\n".encode())
        return end + len(after)

    def find(self, mark: str, start: int) -> int | None:
        """Where the next control string, which has to be that of ``mark``, makes the mark begin."""
        found = self.control.search(self.left, start)
        if found is None:
            return None
        begin = found.start() - mark.index(found[0])
        return begin if self.left.startswith(mark, begin) else None


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read from its formatted text and its loss flags.

    Takes segments as ``format_conversations`` returns them: conversations whole and in order.
    """
    template = template or Template()
    escape = Escape(template.control())
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, flags = None, None, (True, False)
        loss, chars, done = hashlib.sha256(), 0, []

        def close() -> None:
            if reader is not None:
                done.append((last, reader.turns, reader.digest.hexdigest(), chars, loss.hexdigest(), reader.chars, *flags))

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "text", "loss", "valid", "complete"))
            for c, t, learnt, valid, complete in zip(*columns, strict=True):
                if reader is None or c != last:
                    close()
                    reader, last = Reader(template, escape), c
                    loss, chars = hashlib.sha256(), 0
                reader.feed(t)
                if learnt:  # the text under the mask, not the role that was read
                    plain = escape.show(t)
                    chars += len(plain)
                    loss.update(plain.encode())
                flags = (valid, complete)
            if done:
                yield spoken(done, conv_type)
                done.clear()
        close()
        if done:
            yield spoken(done, conv_type)

    return segments.mapInArrow(run, SPOKEN.format(kind=kind))


def spoken(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
