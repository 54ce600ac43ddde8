"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "[INST]" body "[/INST]"                       a user's turn
                  | "<s>" body "</s>"                             an assistant's turn
                  | "[ROLE]" body "[TEXT]" body "[/ROLE]"         any other role
    body         := characters without a control string

A control string inside a body is written with a backslash after its first character, one with n backslashes with
n + 1; nothing else changes, so the escape can be undone. A turn is rendered as it is and parsed again; only where the
parser does not give back the same turn is it escaped, and it must then come back identical.

Turns reach one task per conversation in order and stream through it, so a conversation of any length needs the memory
of a part, not of the whole: a rendered conversation is a sequence of parts of whole turns. Digests are taken from the
rendered parts alone, parsed again.

Results for odd rows: null text is empty, null role is the empty role. Turns are ordered by turn (nulls first), equal
numbers by role, then text; repeated rows are repeated turns. Rows without a conv_id are one conversation with a null
id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Params:
    part_chars: int = 1 << 20  # a part is closed when it has as many characters


DEFAULT = Params()
_CONTROL = re.compile(r"\[(\\*)(/?INST|/?ROLE|TEXT)\]|<(\\*)(/?s)>")
_OPENERS = {"[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>"), "[ROLE]": (None, "[TEXT]")}
_MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}


class GrammarError(ValueError):
    """A text that the grammar does not derive."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _bare(text: str) -> Iterator[re.Match]:
    """The control strings that are not escaped."""
    return (m for m in _CONTROL.finditer(text) if m[0][1] != "\\")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered text; GrammarError if it is none."""
    turns, marks, at = [], _bare(text), 0
    for opener in marks:
        if opener.start() != at or opener[0] not in _OPENERS:
            raise GrammarError(f"no turn at {at}")
        role, closing = _OPENERS[opener[0]]
        middle = next(marks, None)
        if middle is None or middle[0] != closing:
            raise GrammarError(f"open turn at {at}")
        body = unescape(text[opener.end() : middle.start()])
        end = middle
        if role is None:
            end = next(marks, None)
            if end is None or end[0] != "[/ROLE]":
                raise GrammarError(f"open turn at {at}")
            role, body = body, unescape(text[middle.end() : end.start()])
        turns.append((role, body))
        at = end.end()
    if at != len(text):
        raise GrammarError(f"text after the last turn at {at}")
    return turns


def _marked(role: str, text: str) -> tuple[str, int]:
    """A turn between its marks, and where its body begins."""
    if role in _MARKS:
        opening, closing = _MARKS[role]
        return f"{opening}{text}{closing}", len(opening)
    return f"[ROLE]{role}[TEXT]{text}[/ROLE]", len("[ROLE]") + len(role) + len("[TEXT]")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, and where its body begins and ends. Conflicting content is escaped until the parser gives
    back the turn: first the text, then the role."""
    for write in (lambda: (role, text), lambda: (role, escape(text)), lambda: (escape(role), escape(text))):
        try_role, try_text = write()
        out, begin = _marked(try_role, try_text)
        try:
            if parse(out) == [(role, text)]:
                return out, begin, begin + len(try_text)
        except GrammarError:
            pass
    raise AssertionError("an escaped turn did not come back")


RENDERED = "conv_id long, part long, formatted string, loss_spans array<long>"


def _render(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, part, pieces, spans, size = False, None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(pieces)], pa.string()), pa.array([spans], pa.list_(pa.int64()))],
                names=["conv_id", "part", "formatted", "loss_spans"])

        for batch in batches:
            for row_conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if begun and (row_conv != conv or size >= p.part_chars):
                    yield close()
                    part, pieces, spans, size = (part + 1 if row_conv == conv else 0), [], [], 0
                begun, conv = True, row_conv
                out, begin, end = render_turn(role or "", text or "")
                if role == "assistant":
                    spans += [size + begin, size + end]
                pieces.append(out)
                size += len(out)
        if begun:
            yield close()

    return run


def format_conversations(turns: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(conv_id, part, formatted, loss_spans): the parts of every conversation, with begin and end of each span of
    characters that a loss is taken on (the assistants' bodies as written)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_render(p), RENDERED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, rows = None, []

    def close() -> tuple:
        conv, turns, loss, n, loss_chars, chars = state
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in DIGEST.split(", ")])

    for batch in batches:
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
            if state is not None and conv != state[0]:
                rows.append(close())
                state = None
            if state is None:
                state = [conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            for role, body in parse(text):
                state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[3] += 1
            for begin, end in zip(spans[::2], spans[1::2]):
                masked = unescape(text[begin:end])
                state[2].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(masked)
            state[5] += len(text)
        if len(rows) >= 1000:
            yield batch_of(rows)
            rows = []
    if state is not None:
        rows.append(close())
    if rows:
        yield batch_of(rows)


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation from its rendered parts: conv_id, n_turns, turns_sha256 (of role, newline, text, newline
    per turn), loss_chars and loss_sha256 (of the unescaped text under the loss mask), formatted_chars."""
    rows = rendered.select("conv_id", "part", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, DIGEST)
