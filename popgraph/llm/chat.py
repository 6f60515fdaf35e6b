"""Chat formatting: a finite-state machine over roles and a declarative template.

`format_chat` turns conversation rows into text segments with a loss flag; `read_back` parses the
segments again. Both stream over rows sorted by conversation and turn: a conversation of any length
needs the memory of one turn.

Defined cases: null text is empty; a null role is the empty role; a role the template does not know
gets a generic marker that carries its name and makes the turn illegal; turns with equal numbers go by
role, then text; null conversation ids form one conversation; an empty table gives an empty result;
other columns of the input are ignored. Every conversation is formatted, legal or not: `legal` says
whether the machine accepts the turn where it stands.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# state -> role -> next state
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
}
ACCEPTING = {"assistant"}


@dataclass(frozen=True)
class Turn:
    """Markers around a role's text, and whether the text is trained on."""

    opening: str
    closing: str
    loss: bool = False


TEMPLATE = {
    "system": Turn("<sys>", "</sys>"),
    "user": Turn("[INST]", "[/INST]"),
    "assistant": Turn("<s>", "</s>", loss=True),
}
OTHER = Turn("<role %s>", "</role>")

SEGMENTS = "conv_id bigint, turn_no bigint, seg_no bigint, text string, loss boolean, legal boolean"
READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, valid boolean"
)
CHUNK = 3000


class Format:
    """The template's strings, compiled. Control strings start with `[` or `<` and hold neither again."""

    def __init__(self, template: dict[str, Turn]):
        self.template = template
        ends = [t.closing for t in template.values()] + [OTHER.closing]
        starts = [t.opening for t in template.values()]
        tails = "|".join(re.escape(c[1:]) for c in [*starts, *ends]) + r"|role [^<>\[\]]*>"
        self._plain = re.compile(rf"([<\[])(\\*)(?={tails})")
        self._marked = re.compile(rf"([<\[])\\(\\*)(?={tails})")
        self._roles = {t.opening: (role, t) for role, t in template.items()}
        self._opening = re.compile("|".join(map(re.escape, starts)) + r"|<role ([^<>\[\]]*)>")

    def escape(self, text: str) -> str:
        """One backslash goes behind the first character of what reads like a control string."""
        return self._plain.sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        return self._marked.sub(r"\1\2", text)

    def turn(self, role: str) -> Turn:
        known = self.template.get(role)
        return known or Turn(OTHER.opening % quote(role, safe=""), OTHER.closing, OTHER.loss)

    def parse(self, buffer: str) -> tuple[str, str, int] | None:
        """Role, escaped text and length of the turn at the start of `buffer`; None if it isn't whole."""
        head = self._opening.match(buffer)
        if not head:
            return None
        role, kind = self._roles.get(head[0], (None, OTHER))
        at = buffer.find(kind.closing, head.end())
        if at < 0:
            return None
        return unquote(head[1]) if role is None else role, buffer[head.end() : at], at + len(kind.closing)


def _groups(batches, names):
    """Rows of sorted batches as (is the first row of its conversation, values)."""
    last, seen = None, False
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in names]
        for row in zip(*columns):
            first = not seen or row[0] != last
            last, seen = row[0], True
            yield first, row


def _batches(rows, schema):
    names = schema.names

    def flush(chunk):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), schema.types)], names=names)

    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) >= CHUNK:
            yield flush(chunk)
            chunk = []
    if chunk:
        yield flush(chunk)


def format_chat(
    turns: DataFrame, template: dict[str, Turn] = TEMPLATE, machine: dict[str, dict[str, str]] = MACHINE
) -> DataFrame:
    """Segments (conv_id, turn_no, seg_no, text, loss, legal): marker, text, marker for each turn.

    The rows of a conversation stay together and in order in their partition.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("seg_no", pa.int64()), ("text", pa.string()),
         ("loss", pa.bool_()), ("legal", pa.bool_())]
    )

    def rows(batches):
        form, state, n = Format(template), "start", 0
        for first, (conv, role, text) in _groups(batches, ["conv_id", "role", "text"]):
            if first:
                state, n = "start", 0
            state = machine.get(state, {}).get(role, "refused")
            turn, legal = form.turn(role), state != "refused"
            for i, (part, loss) in enumerate(((turn.opening, False), (form.escape(text), turn.loss), (turn.closing, False))):
                yield conv, n, 3 * n + i, part, loss, legal
            n += 1

    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _batches(rows(batches), schema), SEGMENTS)


def read_back(segments: DataFrame, template: dict[str, Turn] = TEMPLATE, accepting: set[str] = ACCEPTING) -> DataFrame:
    """One row per conversation from the output of `format_chat`, which must not be shuffled in between."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
    )

    class State:
        def __init__(self, conv):
            self.conv, self.n, self.buffer, self.role = conv, 0, "", None
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
            self.loss_chars = self.chars = 0
            self.legal = True

        def feed(self, form, text, loss, legal):
            self.buffer += text
            self.chars += len(text)
            self.legal &= legal
            if loss:
                plain = form.unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            while found := form.parse(self.buffer):
                self.role, body, end = found
                self.turns.update(f"{self.role}\n{form.unescape(body)}\n".encode())
                self.buffer, self.n = self.buffer[end:], self.n + 1

        def row(self):
            if self.buffer:
                raise ValueError(f"conversation {self.conv} does not parse")
            valid = self.legal and self.role in accepting
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid

    def rows(batches):
        form, state = Format(template), None
        for first, (conv, text, loss, legal) in _groups(batches, ["conv_id", "text", "loss", "legal"]):
            if first:
                if state:
                    yield state.row()
                state = State(conv)
            state.feed(form, text, loss, legal)
        if state:
            yield state.row()

    return segments.mapInArrow(lambda batches: _batches(rows(batches), schema), READ)
