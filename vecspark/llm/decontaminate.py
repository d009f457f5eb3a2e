"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of each benchmark item; an item
with fewer words is one pattern. Patterns of equal length form one matcher. Its block is
two words (one, for patterns of one word): a shift table over hashed blocks says how
far the search may jump, since no pattern ends within the jump; where the shift is
zero, the bucket of the last block's hash gives the patterns to compare, word by word.
All patterns have the same length within a matcher, so none is missed by jumping.

The benchmark's patterns reach every task, once per Python worker, as arrays: the words' bytes and hashes once, and for each
pattern the number of its first word. Their words are
counted first: up to `PATTERN_WORDS` they are broadcast whole; beyond it the benchmark
is searched in parts of that size, and the hits of the parts are merged by document. The tables grow with the number of patterns.

Null or word-less documents have no words and no hits; null or word-less items have no
window. Every row of docs gives one row, repeated rows too: the hits of several parts are merged by
doc_id and a hash of the text, and given back as often as the row was there. Texts of any length are searched whole; columns
other than the ids and texts are not looked at; an empty benchmark hits nothing and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import textkernel as K
from vecspark.llm.common import Scratch, read

WINDOW = 8
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of benchmark items that one broadcast may carry: about 300 MB in a Python worker.
PATTERN_WORDS = 2_000_000


class Matcher:
    """Patterns of one length, in words: those from the given words of a run of texts on, each with its item."""

    def __init__(self, w: K.Words, length: int, first: np.ndarray, item: np.ndarray):
        self.m, self.block, self.w = length, min(2, length), w
        h = K.grams(w, length)[0][first]
        order = np.lexsort((item, h))
        h, first, item = h[order], first[order], item[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])])
        h, first, item = h[new], first[new], item[new]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([head, [len(h)]]))
        blocks = block_hashes(w.hash, self.block)
        self.bits = max(10, (4 * len(first)).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 250 else np.int32)
        for at in range(length - self.block + 1):  # a later block allows a shorter jump
            self.shift[self.slots(blocks[first[head] + at])] = length - self.block - at
        suffix = self.slots(blocks[first[head] + length - self.block])
        by_suffix = np.argsort(suffix, kind="stable")
        self.suffix, self.first, self.hash = suffix[by_suffix], first[head][by_suffix], h[head][by_suffix]
        self.items_from, self.items_n, self.items = head[by_suffix], n[by_suffix], item

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def hits(self, w: K.Words, i: int, slots: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, items) of all occurrences in text i; h has the hash of the words from each word on."""
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a < self.m:
            return
        jump = self.shift[slots[a : b - self.block + 1]].tolist()  # by the block's first word
        at, last = self.m - self.block, b - a - self.block
        while at <= last:
            s = jump[at]
            if s:
                at += s
                continue
            x = a + at - (self.m - self.block)
            low, high = np.searchsorted(self.suffix, (slots[a + at], slots[a + at] + 1)).tolist()
            for p in low + np.flatnonzero(self.hash[low:high] == h[x]):
                if self._same(w, x, int(self.first[p])):
                    yield x - a, self.items[self.items_from[p] : self.items_from[p] + self.items_n[p]]
            at += 1

    def _same(self, w: K.Words, x: int, p: int) -> bool:
        own = self.w
        return all(
            w.data[w.start[x + j] : w.end[x + j]].tobytes() == own.data[own.start[p + j] : own.end[p + j]].tobytes() for j in range(self.m)
        )


def block_hashes(h: np.ndarray, block: int) -> np.ndarray:
    """Hashes of the blocks from each word on."""
    if block == 1 or len(h) < 2:
        return K.mix(h if block == 1 else h[:0])
    return K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def matchers(texts: list[str], window: int) -> list[Matcher]:
    """One matcher for each length of the patterns; items are numbered as their texts are."""
    w = K.words(pa.array(texts, pa.string()), K.PUNCT)
    size = np.diff(w.first)
    out = []
    for m in np.unique(np.minimum(size[size > 0], window)).tolist():
        if m < window:
            item = np.flatnonzero(size == m)
            first = w.first[item]
        else:
            first = np.flatnonzero(K.grams(w, window)[1])
            item = np.searchsorted(w.first, first, side="right") - 1
        out.append(Matcher(w, m, first, item))
    return out


_built: dict[str, list[Matcher]] = {}


def _search(docs: DataFrame, items, key: str, window: int, spans: bool) -> DataFrame:
    """docs has the columns doc_id, text and digest; items is a broadcast list of (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = matchers([text for _, text in items.value], window)
        own, ids = _built[key], [item for item, _ in items.value]
        for batch in batches:
            for at, texts in K.slices(batch.column(1)):
                w = K.words(texts, K.PUNCT)
                blocks = {b: block_hashes(w.hash, b) for b in {x.block for x in own}}
                slots = [x.slots(blocks[x.block]) for x in own]
                grams = [K.grams(w, x.m)[0] for x in own]
                n, n_hit, found, where = [], [], [], []
                for i in range(len(texts)):
                    size = int(w.first[i + 1] - w.first[i])
                    got: set[int] = set()
                    mark = None
                    for x, slot, h in zip(own, slots, grams, strict=True):
                        for word, some in x.hits(w, i, slot, h):
                            got.update(some.tolist())
                            mark = np.zeros(size, bool) if mark is None else mark
                            mark[word : word + x.m] = True
                    n.append(size)
                    n_hit.append(0 if mark is None else int(mark.sum()))
                    found.append(sorted({ids[k] for k in got}))
                    where.append([] if mark is None else np.flatnonzero(mark).tolist() if spans else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(where, pa.list_(pa.int32())), batch.column(2).slice(at, len(texts))],
                    names=["doc_id", "n_words", "n_hit", "items", "hit_words", "digest"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<string>, hit_words array<int>, digest long")


def contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 2, part_words: int = PATTERN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row of docs."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("digest", F.xxhash64("text"))
    parts = int(total // part_words) + 1
    found = None
    for part in range(parts):
        # each part is within part_words on average; a single item is never split
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        sent = spark.sparkContext.broadcast([tuple(r) for r in some.orderBy("item_id", "text").collect()])
        one = _search(docs, sent, f"{id(sent)}-{sent._jbroadcast.id() if sent._jbroadcast else part}", window, parts > 1)
        found = one if found is None else found.unionAll(one)
    if parts > 1:
        found = found.groupBy("doc_id", "digest").agg(
            (F.count("*") / parts).cast("int").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.collect_list("hit_words")))).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    n = F.size("items").cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= least_items).alias("contaminated"), "items"
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = 1) -> DataFrame:
    """The rows of docs in which fewer than least_items items occur."""
    gone = contamination(spark, docs, benchmark, window, least_items).where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(8, len(ws)) AS m, unnest(list_transform(range(1, len(ws) - least(8, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(8, len(ws)) - 1], ' '))) AS g
  FROM b WHERE len(ws) > 0),
m AS (SELECT DISTINCT m FROM p),
w AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g FROM d, m WHERE len(ws) >= m),
h AS (SELECT doc_id, i, w.m AS m, item_id FROM w JOIN p ON w.m = p.m AND w.g = p.g),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
