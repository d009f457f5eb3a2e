"""Chat formatting with typed content parts.

A message's content is a list of typed parts (text, image, audio, document). A visitor
flattens them in order: a text part gives its escaped text; any other part gives one
placeholder, a reference in the attachment list, and the number of tokens that the
placeholder expands to. A turn is written as

    <|im_start|>ROLE\\nCONTENT<|im_end|>\\n

Control strings inside roles and texts are escaped by a backslash after the `<`: every
`<`, backslashes, `|` gains one backslash, so `<|` from content never stands in the output
and unescaping (taking one backslash away) gives the content back exactly. Roles also
have their line ends escaped. The loss mask covers each assistant text and nothing else.

The rows of a conversation are ordered by turn, then role, then text; nulls first, as
empty strings. Rows of one conversation stream through one task in order, because a
digest over a conversation's turns is sequential; memory stays at one row. Null
conversation ids form one conversation. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import read

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
CONTROL = "<|im_end|><|im_start|>assistant ok"


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0


@dataclass
class Flat:
    """What the visitor gathers: content, attachments as (kind, ref, tokens), text spans in content."""

    content: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    def add(self, piece: str, is_text: bool) -> None:
        if is_text:
            self.spans.append((self.size, self.size + len(piece)))
        self.content.append(piece)
        self.size += len(piece)


class Flatten:
    """Visits parts in order. Token counts: an image has one a patch, audio so many a second, a document so many a page."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def __call__(self, parts: Iterable) -> Flat:
        flat = Flat()
        for p in parts:
            getattr(self, f"visit_{type(p).__name__.lower()}")(p, flat)
        return flat

    def visit_text(self, p: Text, flat: Flat) -> None:
        flat.add(escape(p.text), True)

    def visit_image(self, p: Image, flat: Flat) -> None:
        self._attach("image", p.ref, max(1, -(-p.width // self.patch)) * max(1, -(-p.height // self.patch)), flat)

    def visit_audio(self, p: Audio, flat: Flat) -> None:
        self._attach("audio", p.ref, max(1, round(p.seconds * self.audio_rate)), flat)

    def visit_document(self, p: Document, flat: Flat) -> None:
        self._attach("document", p.ref, max(1, p.pages) * self.page_tokens, flat)

    @staticmethod
    def _attach(kind: str, ref: str, tokens: int, flat: Flat) -> None:
        flat.attachments.append((kind, ref, tokens))
        flat.add(f"<|{kind}_{len(flat.attachments) - 1}|>", False)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@dataclass
class Turn:
    formatted: str
    loss: list[tuple[int, int]]  # spans of formatted under the loss mask
    attachments: list[tuple[str, str, int]]


def format_turn(role: str, parts: Iterable, visit: Flatten | None = None) -> Turn:
    """One turn; its texts are under the loss mask if the role is assistant."""
    flat = (visit or Flatten())(parts)
    head = f"{START}{escape_role(role)}\n"
    loss = [(len(head) + a, len(head) + b) for a, b in flat.spans] if role == "assistant" else []
    return Turn(f"{head}{''.join(flat.content)}{END}\n", loss, flat.attachments)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_spans) by row of (conv_id, turn, role, text): pieces to join by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [format_turn(r or "", [Text(t or "")]) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            spans = pa.array([[list(s) for s in t.loss] for t in turns], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.formatted for t in turns], pa.string()), spans], names=[*b.schema.names, "formatted", "loss_spans"])

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return rows.select(*columns).mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_spans array<array<int>>").drop("role", "text")


def digests(rows: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted turns; see the module."""

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for b in batches:
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        out.append(state.row())
                    state = State(conv)
                turn = format_turn(role, [Text(text)])
                for back_role, back_text in parse(turn.formatted):
                    state.turns += 1
                    state.all.update(f"{back_role}\n{back_text}\n".encode())
                for x, y in turn.loss:
                    piece = unescape(turn.formatted[x:y])
                    state.loss_chars += len(piece)
                    state.loss.update(piece.encode())
                state.chars += len(turn.formatted)
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if state is not None:
            out.append(state.row())
        if out:
            yield _batch(out)

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))]
    ordered = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, _SCHEMA)


_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(extra))


_FORM = "CASE WHEN strpos({0}, '|') > 0 THEN regexp_replace({0}, '<(\\\\*)\\|', '<\\\\\\1|', 'g') ELSE {0} END"
ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + 12 + 1 + length({_FORM.format("text")}) + 10 + 1) AS chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM a
"""
