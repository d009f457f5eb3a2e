"""Token counts by section, from the offsets of whole-document encodings.

A document is encoded once, as a whole. Byte-level tokens tile its UTF-8 bytes, so
running sums of token lengths give each token's byte span. Those spans are joined with
the spans of the document's sections by a sorted search. A token that crosses a boundary is
allocated by an explicit rule:

    "first"    to the section that holds its first byte (the default; counts stay whole)
    "most"     to the section that holds most of its bytes, the earlier one on a tie
    "share"    to every section by its share of the token's bytes (counts are fractions)

Sections are a document's lines, each with its line end, so they tile the text and counts
add up to the document's. The first line is its head, the others its body. Empty and null
texts have one empty head of no tokens. Rows are independent; repeated ids repeat.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm.common import read

TOKENIZER = "byte_bpe_50k.tiktoken"
RULES = ("first", "most", "share")


def default_tokenizer() -> tuple[str, str]:
    """The path of the rank file and its pre-tokenizing pattern."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


class Counter:
    """One tokenizer; spans() gives the byte offsets of a text's tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> np.ndarray:
        """Byte offsets between tokens, one more than tokens."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate([[0], np.cumsum(self.length[ids])])


def attribute(token_at: np.ndarray, section_at: np.ndarray, rule: str = "first") -> np.ndarray:
    """Tokens of each section; both arguments are byte offsets that tile the same text."""
    n = len(section_at) - 1
    start, end = token_at[:-1], token_at[1:]
    first = np.clip(np.searchsorted(section_at, start, side="right") - 1, 0, max(0, n - 1))
    if rule == "first":
        return np.bincount(first, minlength=n).astype(np.float64)
    last = np.clip(np.searchsorted(section_at, end, side="left") - 1, 0, max(0, n - 1))
    inside = first == last
    out = np.bincount(first[inside], minlength=n).astype(np.float64)
    for i in np.flatnonzero(~inside).tolist():
        at = np.arange(first[i], last[i] + 1)
        part = np.minimum(section_at[at + 1], end[i]) - np.maximum(section_at[at], start[i])
        if rule == "most":
            out[at[part.argmax()]] += 1
        else:
            out[at] += part / (end[i] - start[i])
    return out


_loaded: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Counter(path, pattern)
    return _loaded[path, pattern]


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte offsets of the lines of a text, line ends included."""
    at = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(data)]])) if len(data) else np.array([0, 0])


_FOUND = "doc_id long, section int, kind string, start_char long, n_chars long, n_tokens double"


def section_counts(docs: DataFrame, path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, kind, start_char, n_chars, n_tokens) for each section of each row."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _counter(path, pattern)
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                section, start, size, tokens, rows = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    at = line_sections(data)
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
                    n = len(at) - 1
                    rows.append(n)
                    section.append(np.arange(n))
                    start.append(chars[:-1])
                    size.append(np.diff(chars))
                    tokens.append(attribute(own.spans(text), at, rule) if text else np.zeros(1))
                section = np.concatenate(section)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), rows)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(section, pa.int32()), pa.array(np.where(section == 0, "head", "body").tolist()), pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(tokens))],
                    names=[c.split()[0] for c in _FOUND.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _FOUND)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = section_counts(read(spark, sf_dir, "documents"), *default_tokenizer())
    return counts.withColumn("n_tokens", F.col("n_tokens").cast("long"))
