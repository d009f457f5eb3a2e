import math
import random
import re
from collections import Counter

import pytest

from llm_helpers import documents, prose, rows_of
from vecspark.llm import bm25 as S


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k=10, k1=1.2, b=0.75):
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    df = Counter(w for _, bag, _ in bags for w in bag)
    mean = sum(n for *_, n in bags) / len(bags)
    out = {}
    for q, text in queries:
        scores = []
        for i, bag, n in bags:
            own = [w for w in set(words(text)) if w in bag]
            if own and i != q:
                s = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * n / mean)) for w in own)
                scores.append((s, i))
        out[q] = sorted(scores, key=lambda x: (-x[0], x[1]))
    return out


def check(found, want, k):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q, best in want.items():
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, min(k, len(best)) + 1))
        for (_, i, s), (t, _) in zip(mine, best, strict=False):
            assert s == pytest.approx(t, rel=1e-9)
            assert any(i == j and t == pytest.approx(u, rel=1e-9) for u, j in best)
        for (_, i, s), (_, j, t) in zip(mine, mine[1:], strict=False):
            assert s > t or (s == t and i < j) or s == pytest.approx(t, rel=1e-9)
    assert set(got) <= set(want)


@pytest.mark.parametrize("pairs", [S.PASS_PAIRS, 200])
def test_random_texts(spark, monkeypatch, pairs):
    monkeypatch.setattr(S, "PASS_PAIRS", pairs)  # several passes over the shards
    monkeypatch.setattr(S, "PIECE_PAIRS", pairs // 3)
    r = random.Random(1)
    docs = [(i, prose(i, r.randrange(0, 200), r.choice([5, 60, 3000])) + r.choice(["", " The THE the", " é-x"])) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]  # ties
    queries = [d for d in docs if d[0] % 25 == 0]
    df = documents(spark, docs).repartition(6)
    check(S.top_documents(spark, df, df.where("doc_id % 25 = 0")), brute(docs, queries), 10)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(50)] + [(99, "other")]
    df = documents(spark, docs).repartition(5)
    got = S.top_documents(spark, df, df.where("doc_id = 7"), k=4)
    assert rows_of(got, "rank", "doc_id") == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_pruning_keeps_the_best(spark):
    """Frequent words in every document, so that blocks are skipped by their largest impacts."""
    r = random.Random(2)
    docs = [(i, " ".join(["the"] * r.randrange(1, 30) + ["of"] * r.randrange(0, 9) + [f"w{r.randrange(4000)}" for _ in range(r.randrange(1, 60))])) for i in range(1500)]
    queries = [d for d in docs if d[0] % 100 == 0]
    df = documents(spark, docs).coalesce(1)
    check(S.top_documents(spark, df, df.where("doc_id % 100 = 0")), brute(docs, queries), 10)


def test_long_queries_cost_little_beside_the_index():
    """Queries of hundreds of words, on which bounds skip nothing: the work of a run is a small part of indexing the shard."""
    import time

    import numpy as np
    import pyarrow as pa

    r = np.random.Generator(np.random.PCG64(3))
    words_ = np.minimum(r.zipf(1.25, (6000, 300)), 10**6)
    texts = pa.array([" ".join(map("w{}".format, row)) for row in words_.tolist()])
    began = time.perf_counter()
    shard = S.Shard(texts, 300.0)
    indexed = time.perf_counter() - began
    rows, terms, _, _ = S._bags(texts.slice(0, 256))
    own = [(terms[rows == i], 1 + np.arange(int((rows == i).sum())) / 7) for i in range(256)]
    began = time.perf_counter()
    got = [o for x in range(0, 256, S.RUN) for o in shard.search_run(own[x : x + S.RUN], np.zeros(S.RUN), 10, [np.array([x + i]) for i in range(S.RUN)])]
    assert time.perf_counter() - began < indexed / 4
    forward = np.repeat(np.arange(6000), np.diff(shard.f_at))
    for i in range(0, 256, 16):
        weight = np.zeros(len(shard.terms))
        weight[np.searchsorted(shard.terms, own[i][0])] = own[i][1]
        score = np.bincount(forward, weight[shard.f_slot] * shard.f_impact)
        score[i] = 0
        found, exact = got[i]
        assert np.allclose(score[found], exact) and set(np.argsort(-score)[:10].tolist()) <= set(found.tolist())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(S.op8_bm25_topk(spark, sf), brute(docs, [d for d in docs if d[0] % 100 == 0]), 10)


def test_messy_rows(spark, messy):
    got = S.top_documents(spark, messy, messy)
    assert not got.where("doc_id IS NULL OR query_id IS NULL OR query_id = doc_id OR query_id IN (3, 4, 5)").count()
    assert got.where("query_id = 7 AND doc_id = 8 AND rank = 1").count()
    assert S.top_documents(spark, messy.where("false"), messy).count() == 0
    assert S.top_documents(spark, messy, messy.where("false")).count() == 0
