"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of character classes, word and line lengths,
repetition, diversity) are made for many documents at once with array operations. The
trees are grown on the driver from at most `SAMPLE` labelled rows, chosen by a hash of their id:
this is a bound on what is fitted, documented here; every document is scored. The
fitted trees are flattened into arrays of features, thresholds, children and values, and
all documents descend all trees together.

Null and empty texts have all-zero statistics and get the score of those. Labels that are
null are ignored; several labels of a document are averaged. With no usable labels every
score is 0.5. Rows are independent, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecspark.llm import textkernel as K
from vecspark.llm.common import free_name, read

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "upper", "digit", "space", "line_end", "period", "comma", "bang", "bar", "symbol", "other_punctuation",
    "non_ascii", "log_lines", "line_length", "short_lines", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "longest_repeat", "symbol_ends", "repeat_lines",
)

_CLASS = np.zeros(256, np.int64)  # of lower-cased bytes, but for upper
for i, chars in enumerate((b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"|", b"#%$&*@^~=+<>_{}[]\\", b"\"'():;?/-`"), 1):
    _CLASS[list(chars)] = i
_CLASS[128:] = 10
_SYMBOL_END = np.zeros(256, bool)
_SYMBOL_END[list(b"#%$&*@^~=+_|!")] = True


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text: distinct values of h, and the count of the commonest."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, int)
    count = np.diff(np.concatenate([heads, [len(h)]]))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of[heads], count)
    return np.bincount(of[heads], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, _ = K.raw_bytes(texts)
    w = K.words(texts, K.SPACE)
    n = len(texts)
    size = np.diff(w.text_at)
    text_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(text_of * 11 + _CLASS[raw], minlength=n * 11).reshape(n, 11)
    upper = np.bincount(text_of[(raw >= 65) & (raw <= 90)], minlength=n)
    nw = np.diff(w.first)
    word_of = np.repeat(np.arange(n), nw)
    length = (w.end - w.start).astype(np.float64)
    some, words_ = np.maximum(size, 1), np.maximum(nw, 1)
    mean = np.bincount(word_of, length, n) / words_
    sd = np.sqrt(np.maximum(np.bincount(word_of, length**2, n) / words_ - mean**2, 0))
    same_text = word_of[1:] == word_of[:-1]
    again = same_text & (w.hash[1:] == w.hash[:-1])
    run = np.zeros(len(w.hash), np.int64)
    if len(again):
        at = np.arange(1, len(w.hash))
        run[1:] = np.where(again, at - np.maximum.accumulate(np.where(again, 0, at)), 0)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, word_of, run)
    distinct, top = _distinct(w.hash, word_of, n)
    pairs, _ = _distinct(K.mix(w.hash[1:] * np.uint64(31) + w.hash[:-1])[same_text], word_of[1:][same_text], n)
    # lines: between line ends
    end = np.flatnonzero(raw == 10)
    lines = np.bincount(text_of[end], minlength=n) + 1
    edge = np.unique(np.concatenate([w.text_at[:-1], end + 1]))
    edge = edge[edge < len(raw)]
    line_size = np.diff(np.concatenate([edge, [len(raw)]]))
    line_of = text_of[edge] if len(edge) else np.zeros(0, int)
    short = np.bincount(line_of[line_size < 20], minlength=n)
    # a line's hash: from its first and last words and their number
    first = np.searchsorted(w.start, edge)
    last = np.searchsorted(w.start, edge + line_size)
    full = first < last
    line_hash = K.mix(w.hash[first[full]] * np.uint64(3) + w.hash[last[full] - 1] * np.uint64(7) + (last - first)[full].astype(np.uint64))
    line_kinds, _ = _distinct(line_hash, line_of[full], n)
    full_lines = np.maximum(np.bincount(line_of[full], minlength=n), 1)
    ends = np.bincount(word_of[_SYMBOL_END[w.data[w.end - 1]]], minlength=n) if len(w.end) else np.zeros(n)
    out = np.stack(
        [
            np.log1p(size), np.log1p(nw), mean, sd, upper / some, *(kinds[:, i] / some for i in range(1, 10)), kinds[:, 10] / some, np.log(lines), np.log1p(size / lines), short / lines,
            distinct / words_, top / words_, np.bincount(word_of[1:][again], minlength=n) / words_, pairs / words_, np.log1p(longest), ends / words_, 1 - line_kinds / full_lines,
        ],
        axis=1,
    )
    out[size == 0] = 0
    return out.astype(np.float32)


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf is its own child."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.root, (len(part), len(self.root)))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[at : at + 2048] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, leaves: int = 15, rate: float = 0.1, bins: int = 64, least: int = 20, penalty: float = 1.0) -> Trees:
    """Leaf-wise histogram boosting of the logistic loss."""
    n, width = x.shape
    y = y.astype(np.float64)
    if not n:
        none = np.zeros(0, int)
        return Trees(0.0, none, none, none, none, np.zeros(0), none, 0)
    cuts = [np.unique(np.quantile(x[:, f].astype(np.float64), np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f].astype(np.float64)) for f, c in enumerate(cuts)], axis=1)
    slot = binned + np.arange(width) * bins
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    raw = np.full(n, base)
    feature, threshold, left, right, value, roots, depth = [], [], [], [], [], [], 0

    def node(v: float) -> int:
        at = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(at), right.append(at), value.append(v)
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)

        def best(rows: np.ndarray, g=g, h=h):
            s = slot[rows].ravel()
            gs = np.bincount(s, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
            hs = np.bincount(s, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
            ns = np.bincount(s, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
            tg, th, tn = gs[:, -1:], hs[:, -1:], ns[:, -1:]
            gain = gs**2 / (hs + penalty) + (tg - gs) ** 2 / (th - hs + penalty) - tg**2 / (th + penalty)
            gain[(ns < least) | (tn - ns < least)] = -1
            at = int(gain.argmax())
            return float(gain.flat[at]), at // bins, at % bins

        roots.append(node(0.0))
        open_ = [(best(np.arange(n)), np.arange(n), roots[-1], 0)]
        done = []
        while open_ and len(open_) + len(done) < leaves:
            open_.sort(key=lambda q: q[0][0])
            (gain, f, b), rows, at, deep = open_.pop()
            if gain <= 1e-6 or b >= len(cuts[f]):
                done.append((rows, at))
                continue
            go = binned[rows, f] <= b
            feature[at], threshold[at] = f, np.float32(cuts[f][b])
            # thresholds are compared in single precision, as the statistics are
            left[at], right[at] = node(0.0), node(0.0)
            depth = max(depth, deep + 1)
            for part, child in ((rows[go], left[at]), (rows[~go], right[at])):
                open_.append((best(part), part, child, deep + 1))
        for rows, at in [*done, *((rows, at) for _, rows, at, _ in open_)]:
            value[at] = -rate * float(g[rows].sum() / (h[rows].sum() + penalty))
            raw[rows] += value[at]
    return Trees(base, np.array(feature), np.array(threshold, np.float32), np.array(left), np.array(right), np.array(value), np.array(roots), depth)


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most `sample` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(~_held_out()).groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id")  # `known` has at most `sample` rows of two numbers
    # a repeated id is one document, whichever of its texts comes first by hash
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality")).select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in K.slices(b.column(0)):
                x = statistics(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32())), b.column(1).slice(at, len(part))], names=["x", "y"]
                )

    got = rows.mapInArrow(run, "x array<float>, y double").toPandas()
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(FEATURES))
    y = (got["y"].to_numpy() >= 0.5).astype(np.int64)
    order = np.lexsort((*x.T, y))  # fitting does not depend on the order of rows
    return fit(x[order], y[order])


def scored(spark: SparkSession, docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with its score in a last column, score (with underscores before it if docs has one of that name)."""
    sent = spark.sparkContext.broadcast(trees)
    names = docs.columns
    score_col, text_col = free_name(names, "score"), free_name(names, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in K.slices(b.column(len(names))):
                score = sent.value.score(statistics(texts))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in b.columns[:-1]), pa.array(score)], names=[*names, score_col])

    return docs.select(*[F.col(c) for c in names], F.col("text").cast("string").alias(text_col)).mapInArrow(run, StructType([*docs.schema.fields]).add(score_col, "double"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns as they were."""
    out = scored(spark, docs, train(docs, labels))
    return out.where(F.col(out.columns[-1]) >= threshold).select(docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(spark, docs.select("doc_id", "text"), train(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
