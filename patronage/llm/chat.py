"""Chat formatting with a grammar round trip.

A turn is written as an opening marker, its text, and a closing marker:

    user       [INST] text [/INST]          system   <<SYS>> text <</SYS>>
    assistant  <s> text </s>                others   <|role|>name<|text|> text <|end|>

(without the blanks). Each rendered turn is parsed again; if the parser does not give back the source,
the control strings in the text are escaped, and again until it does: a marker gets a backslash in
front, and backslashes that stand directly before a marker are doubled. The parser reads a marker
after an odd number of backslashes as text. The loss mask covers the text of assistant turns.

The output has one row per turn in order of (conv_id, turn, role, text), so no conversation is ever
held as a whole; put together, the pieces of a conversation are its formatted text. Reading back is a stream over
the sorted pieces that keeps a few numbers and two running digests per conversation.

Nulls: a null text is empty, a null role is the empty role, null conversations and turns come first.
Repeated rows stay repeated. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import block_count

OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "<|role|>", "<|text|>", "<|end|>"

MARKERS = [*OPEN.values(), *CLOSE.values(), OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE]
_MARKER = re.compile(r"(\\*)(" + "|".join(map(re.escape, MARKERS)) + ")")
_ROLE_OF = {marker: role for role, marker in OPEN.items()}

PIECES = "conv_id long, turn long, piece string, loss_start int, loss_end int"


def escape(text: str) -> str:
    """Every marker gets a backslash, the backslashes right before one (or at the end) are doubled."""
    text = _MARKER.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    tail = len(text) - len(text.rstrip("\\"))
    return text + "\\" * tail


def unescape(text: str) -> str:
    """Undo :func:`escape`; text without markers and trailing backslashes is itself."""
    text = _MARKER.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)
    tail = len(text) - len(text.rstrip("\\"))
    return text[: len(text) - tail // 2] if tail else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of formatted text; raises ValueError on text that is not of the grammar."""
    turns, at, role, expected, begin = [], 0, None, None, 0
    for m in _MARKER.finditer(formatted):
        if len(m[1]) % 2:
            continue  # an escaped marker is text
        marker, where = m[2], m.start(2)
        if expected is None:
            if where != at or m[1] or marker not in (*_ROLE_OF, OTHER_OPEN):
                raise ValueError(f"no opening marker at {at}")
            role = _ROLE_OF.get(marker)
            expected = CLOSE[role] if role else OTHER_TEXT
            begin = m.end()
        elif marker != expected:
            raise ValueError(f"{marker} at {where} where {expected} should be")
        elif marker == OTHER_TEXT:
            role, expected, begin = unescape(formatted[begin:where]), OTHER_CLOSE, m.end()
        else:
            turns.append((role, unescape(formatted[begin:where])))
            at, expected = m.end(), None
    if expected is not None or at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to (role, text), and where its text lies in it."""
    name, body = role, text
    for _ in range(2):
        head = OPEN[role] if role in OPEN else OTHER_OPEN + name + OTHER_TEXT
        formatted = head + body + CLOSE.get(role, OTHER_CLOSE)
        try:
            if parse(formatted) == [(role, text)]:
                return formatted, len(head), len(head) + len(body)
        except ValueError:
            pass
        name, body = escape(role), escape(text)
    raise ValueError(f"turn of role {role!r} does not survive the round trip")


def format_turns(turns: DataFrame) -> DataFrame:
    """Rendered pieces of ``turns`` (conv_id, turn, role, text), one row for each, any order: piece and,
    for assistants, the span of it that the loss covers (code points)."""
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_render, PIECES)


def read_conversations(pieces: DataFrame) -> DataFrame:
    """One row per conversation of the formatted pieces: number of turns, digests of the parsed turns
    and of the text under the loss mask, lengths in code points."""
    ordered = pieces.repartition(block_count(pieces.sparkSession), "conv_id").sortWithinPartitions(
        "conv_id", "turn", "piece"
    )
    return ordered.mapInArrow(
        _read,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces, starts, ends = [], [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            piece, start, end = render(role, text)
            pieces.append(piece)
            starts.append(start if role == "assistant" else None)
            ends.append(end if role == "assistant" else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), pa.array(pieces, pa.string()),
             pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
            ["conv_id", "turn", "piece", "loss_start", "loss_end"],
        )


class _Conversation:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        for role, text in parse(piece):
            self.turns += 1
            self.digest.update(f"{role}\n{text}\n".encode())
        self.chars += len(piece)
        if start is not None:
            loss = unescape(piece[start:end])
            self.loss_chars += len(loss)
            self.loss_digest.update(loss.encode())

    def row(self) -> tuple:
        digests = self.digest.hexdigest(), self.loss_digest.hexdigest()
        return self.conv_id, self.turns, digests[0], self.loss_chars, digests[1], self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows(found: list[_Conversation]) -> pa.RecordBatch:
        columns = list(zip(*[c.row() for c in found], strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    now: _Conversation | None = None
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")]
        for conv_id, piece, start, end in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now:
                    done.append(now)
                now = _Conversation(conv_id)
            now.add(piece, start, end)
        yield rows(done)
    yield rows([now] if now else [])
