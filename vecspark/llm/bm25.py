"""Exact BM25 top-k search, run by shard.

A query is the set of a document's distinct words. Document frequencies, the number of
documents and their mean length are counted over all documents first. Each run of
documents of bounded size (a shard, inside one task) is indexed in memory: postings by term
with their BM25 impacts; for frequent terms, a table by document.

Scores of frequent terms are a product of matrices: a run of queries by terms, and terms by documents, which hardly costs
more than reading the table once a run. Postings of rare terms are then added for each query. Queries are whole documents of
hundreds of terms, for which bounds by block or term skip next to nothing but cost as much as the scores
they bound, so none are kept. The documents that reach the threshold (the k-th best score so far) or the shard's own
k-th best are scored again from a forward index, in double precision. The threshold
carries over between the shards that one Python worker handles, as the k-th best of any
part bounds the k-th best of the whole from below. Shards emit at most k rows a query;
a final window merges them exactly. Ties go to the smaller doc_id.

Queries are sent in blocks of bounded size, one pass over the shards for each, so the query
set may grow with the corpus. A document is not its own result. Null texts and texts
without words match nothing; rows that share no word with a query are no results, so a
query may have fewer than k. Rows that share a doc_id are scored by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.llm import textkernel as K
from vecspark.llm.common import Scratch, read

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES = 32 << 20
#: Queries whose frequent terms are scored at once.
RUN = 64
#: (query, term) pairs, of 16 bytes, that one pass over the shards may take, and that the driver handles at once.
PASS_PAIRS = 4_000_000
PIECE_PAIRS = 100_000
#: Relative room for single precision.
MARGIN = 1e-4


def _bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of the distinct words of each text, sorted by text and term; and words by text."""
    rows, terms, counts, sizes = [], [], [], []
    for at, part in K.slices(texts):
        w = K.words(part, K.PUNCT)
        n = np.diff(w.first)
        of = np.repeat(np.arange(len(part)), n)
        order = np.lexsort((w.hash, of))
        h, of = w.hash[order], of[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, int)
        rows.append(of[head] + at)
        terms.append(h[head])
        counts.append(np.diff(np.concatenate([head, [len(h)]])))
        sizes.append(n)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(rows, int), cat(terms, np.uint64), cat(counts, int), cat(sizes, int)


def _runs(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.Table]:
    """Tables of about limit text bytes."""
    kept, size = [], 0
    for b in batches:
        for at, part in K.slices(b.column(text), limit // 4):
            kept.append(b.slice(at, len(part)))
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _frequencies(docs: DataFrame) -> DataFrame:
    """(term, df), with the counts of documents and words as the terms null and null with a sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 0, SHARD_BYTES):
            _, terms, _, sizes = _bags(t.column(0).combine_chunks())
            terms, df = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([terms.view(np.int64), [0, 0]])), pa.array(np.concatenate([df, [len(sizes), sizes.sum()]])), pa.array(np.concatenate([np.zeros(len(df), np.int32), [1, 2]]).astype(np.int32))],
                names=["term", "n", "kind"],
            )

    return docs.select("text").mapInArrow(run, "term long, n long, kind int").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def _terms(docs: DataFrame) -> DataFrame:
    """(query_id, term) of the distinct words of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            rows, terms, _, _ = _bags(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(terms.view(np.int64))], names=["query_id", "term"])

    return docs.select("doc_id", "text").mapInArrow(run, "query_id long, term long").distinct()


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. of each size, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, int)


class Shard:
    """Inverted and forward index of a run of documents.

    Terms in at least a sixteenth of the documents are frequent: their impacts are rows of a table by document.
    The others have posting lists.
    """

    def __init__(self, texts: pa.Array, mean: float):
        rows, terms, tf, sizes = _bags(texts)
        self.n = len(texts)
        norm = K1 * (1 - B + B * sizes / max(mean, 1e-9))
        self.terms, slot = np.unique(terms, return_inverse=True)
        impact = tf * (K1 + 1) / (tf + norm[rows])
        # forward: by document, terms ascending
        self.f_at = np.searchsorted(rows, np.arange(self.n + 1))
        self.f_slot, self.f_impact = slot, impact
        size = np.bincount(slot, minlength=len(self.terms))
        often = size >= max(8, self.n // 16)
        self.often = np.where(often, np.cumsum(often) - 1, -1)
        wide = often[slot]
        table = np.zeros((int(often.sum()), self.n), np.float32)
        table[self.often[slot[wide]], rows[wide]] = impact[wide]
        self.table = table
        rare = np.flatnonzero(~wide)
        rare = rare[np.argsort(slot[rare], kind="stable")]
        self.doc, self.impact = rows[rare].astype(np.int32), impact[rare]
        self.at = np.searchsorted(slot[rare], np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms))

    def slots(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, weights) of the terms that are here."""
        slot = np.searchsorted(self.terms, terms)
        slot[slot == len(self.terms)] = 0
        here = self.terms[slot] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return slot[here], idf[here]

    def search_run(self, queries: list[tuple[np.ndarray, np.ndarray]], theta: np.ndarray, k: int, skip: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, idf): see search."""
        queries = [self.slots(*q) for q in queries]
        weights = np.zeros((len(queries), len(self.table)), np.float32)
        for at, (slot, idf) in enumerate(queries):
            row = self.often[slot]
            weights[at, row[row >= 0]] = idf[row >= 0]
        for (slot, idf), frequent, least, out in zip(queries, weights @ self.table, theta.tolist(), skip, strict=True):
            yield self.search(slot, idf, frequent, least, k, out)

    def search(self, slot: np.ndarray, idf: np.ndarray, frequent: np.ndarray, theta: float, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): those that reach theta and may be among the best k, with their exact scores; skip: left out.

        frequent has what the frequent terms give each document.
        """
        none = np.zeros(0, int), np.zeros(0)
        if not len(slot):
            return none
        size = self.at[slot + 1] - self.at[slot]
        spot = _spans(self.at[slot], size)
        score = np.bincount(self.doc[spot], np.repeat(idf, size) * self.impact[spot], self.n) + frequent
        score[skip] = 0
        need = theta
        if np.count_nonzero(score >= max(need, 1e-300)) > k:
            need = max(need, float(np.partition(score, len(score) - k)[len(score) - k]))
        found = np.flatnonzero((score >= need * (1 - MARGIN)) & (score > 0))
        if not len(found):
            return none
        # single precision has chosen; exact scores are summed in the order of terms
        self.weight[slot] = idf
        x, n = self.f_at[found], self.f_at[found + 1] - self.f_at[found]
        spot = np.repeat(x - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        exact = np.bincount(np.repeat(np.arange(len(found)), n), self.weight[self.f_slot[spot]] * self.f_impact[spot], len(found))
        self.weight[slot] = 0
        good = exact >= theta
        return found[good], exact[good]


_theta: dict[str, np.ndarray] = {}


_held: dict[str, tuple] = {}


def _joined(run_id: str, sent: list) -> tuple:
    """(ids, offsets, terms, weights) from the pieces that were sent; kept by the worker for its next task."""
    if run_id not in _held:
        _held.clear()
        parts = [p.value for p in sent]
        sizes = np.concatenate([p[1] for p in parts])
        _held[run_id] = np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    return _held[run_id]


def _searched(docs: DataFrame, sent, run_id: str, mean: float, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, terms, idf = _joined(run_id, sent)
        if run_id not in _theta:
            _theta.clear()
            _theta[run_id] = np.zeros(len(ids))
        theta = _theta[run_id]
        for t in _runs(batches, 1, SHARD_BYTES):
            doc = np.asarray(t.column(0).combine_chunks())
            shard = Shard(t.column(1).combine_chunks(), mean)
            out: tuple[list, list, list] = ([], [], [])
            order = np.argsort(doc, kind="stable")
            own_from, own_to = np.searchsorted(doc[order], ids), np.searchsorted(doc[order], ids, side="right")
            for x in range(0, len(ids), RUN):
                some = range(x, min(x + RUN, len(ids)))
                own = [(terms[at[q] : at[q + 1]], idf[at[q] : at[q + 1]]) for q in some]
                got = shard.search_run(own, theta[x : x + RUN].copy(), k, [order[own_from[q] : own_to[q]] for q in some])
                for q, (found, score) in zip(some, got, strict=True):
                    if not len(found):
                        continue
                    best = np.lexsort((doc[found], -score))[:k]
                    if len(best) == k:
                        theta[q] = max(theta[q], score[best[-1]])
                    out[0].append(np.full(len(best), ids[q]))
                    out[1].append(doc[found[best]])
                    out[2].append(score[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "doc_id", "score"])

    return docs.mapInArrow(run, "query_id long, doc_id long, score double")


def top_documents(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of docs for each row of queries (doc_id, text)."""
    scratch = Scratch(spark)
    clean = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    docs, queries = clean(docs), clean(queries)
    df = scratch.put(_frequencies(docs), "df")
    totals = {r["kind"]: r["n"] for r in df.where("kind > 0").select("kind", "n").collect()}
    n, mean = totals.get(1, 0), totals.get(2, 0) / max(totals.get(1, 0), 1)
    idf = F.log(1 + (F.lit(float(n)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    pairs = scratch.put(_terms(queries).join(df.where("kind = 0").select("term", "n"), "term").select("query_id", "term", idf.alias("idf")), "queries")
    total = pairs.count()
    passes = total // PASS_PAIRS + 1
    pieces = passes * (min(total, PASS_PAIRS) // PIECE_PAIRS + 1)
    found = None
    for at in range(passes):
        sent = []
        for piece in range(at, pieces, passes):
            # a piece holds PIECE_PAIRS on average, and every term of its queries
            got = pairs.where(F.pmod(F.xxhash64("query_id"), F.lit(pieces)) == piece).toArrow()
            q, term, weight = (np.asarray(c.combine_chunks()) for c in got.columns)
            order = np.lexsort((term.view(np.uint64), q))
            ids, sizes = np.unique(q, return_counts=True)
            sent.append(spark.sparkContext.broadcast((ids, sizes, term[order].view(np.uint64), weight[order])))
        one = _searched(docs, sent, uuid.uuid4().hex, mean, k)
        found = one if found is None else found.unionAll(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return top_documents(spark, docs, docs.where("doc_id % 100 = 0"))
