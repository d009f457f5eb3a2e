import random

import numpy as np
import pytest

from llm_helpers import documents, prose, rows_of
from vecspark.llm import tokencount as T


@pytest.fixture(scope="module")
def counter():
    return T.Counter(*T.default_tokenizer())


def spans(counter, text):
    """(start, end) bytes of each token, from the tokens' own bytes."""
    at, out = 0, []
    for i in counter.encoding.encode_ordinary(text):
        n = len(counter.encoding.decode_single_token_bytes(i))
        out.append((at, at + n))
        at += n
    assert at == len(text.encode())
    return out


def brute(counter, text, rule):
    data = text.encode()
    lines = data.splitlines(keepends=True) if data.count(b"\r") == 0 else None
    if lines is None or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x85  "):
        lines = [x + b"\n" for x in data.split(b"\n")[:-1]] + ([data.split(b"\n")[-1]] if data.split(b"\n")[-1] else [])
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    out = np.zeros(len(lines))
    for a, b in spans(counter, text):
        parts = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        held = [i for i, p in enumerate(parts) if p]
        if rule == "first":
            out[held[0]] += 1
        elif rule == "most":
            out[max(held, key=lambda i: (parts[i], -i))] += 1
        else:
            for i in held:
                out[i] += parts[i] / (b - a)
    return [len(x.decode()) for x in lines], out


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_equal_brute_force(spark, counter, rule):
    r = random.Random(4)
    bits = ["\n", "\n\n\n", " \n  \n", "é", "日本 ", "word ", "a,b. ", "\r\n", "😀", " ", "    x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    got = {}
    for x in T.section_counts(documents(spark, texts).repartition(3), *T.default_tokenizer(), rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        sizes, tokens = brute(counter, t, rule)
        assert [x["n_chars"] for x in got[i]] == sizes and [x["start_char"] for x in got[i]] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
        assert np.allclose([x["n_tokens"] for x in got[i]], tokens)
        assert [x["kind"] for x in got[i]] == ["head"] + ["body"] * (len(sizes) - 1)


def test_counts_add_up(spark, counter):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = T.op9_token_counts(spark, sf).groupBy("doc_id").sum("n_tokens", "n_chars").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {i: (len(counter.encoding.encode_ordinary(t or "")), len(t or "")) for i, t in texts.items()}


def test_unknown_rule(spark, messy):
    with pytest.raises(ValueError):
        T.section_counts(messy, *T.default_tokenizer(), rule="last")


def test_messy_rows(spark, messy, counter):
    got = T.section_counts(messy, *T.default_tokenizer())
    assert got.columns == ["doc_id", "section", "kind", "start_char", "n_chars", "n_tokens"]
    assert rows_of(got.where("doc_id IN (3, 4)"), "doc_id", "section", "n_chars", "n_tokens") == [(3, 0, 0, 0.0), (4, 0, 0, 0.0)]
    assert got.where("doc_id = 1").agg({"n_tokens": "sum"}).first()[0] == 2 * len(counter.encoding.encode_ordinary(prose(1, 80)))
    assert T.section_counts(messy.where("false"), *T.default_tokenizer()).count() == 0
