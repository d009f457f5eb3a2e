import hashlib
import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

from llm_helpers import documents, prose, rows_of
from vecspark.llm import decontaminate as D

ITEM = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=8):
    patterns = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for i in range(len(w) - m + 1):
                if (p := tuple(w[i : i + m])) in patterns:
                    hit |= set(range(i, i + m))
                    found |= patterns[p]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("part_words", [D.PATTERN_WORDS, 100])
def test_random_texts(spark, part_words):
    r = random.Random(8)
    items = [(i, prose(i, r.choice([1, 2, 3, 7, 8, 9, 20, 40]), r.choice([3, 50, 5000]))) for i in range(40)] + [(50, ""), (51, None), (52, "É é-E'x_y\x7fz"), (9, "w1, W1; w1! w1")]
    docs = []
    for i in range(150):
        t = prose(700 + i, r.randrange(0, 120), r.choice([3, 50, 5000])).split()
        if i % 2:
            w = (r.choice(items)[1] or "").upper().split()
            at = r.randrange(len(t) + 1)
            t[at:at] = w[r.randrange(3) :]
        docs.append((i, r.choice([" ", ", ", "\n--"]).join(t)))
    docs += [(900, None), (901, ""), (902, "é é e x y Z"), (903, "..."), (904, "é é e x_y")]
    got = D.contamination(spark, documents(spark, docs).repartition(3), spark.createDataFrame(items, ITEM), part_words=part_words)
    assert rows_of(got, *COLUMNS) == sorted(brute(docs, items), key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(D.op5_decontaminate(spark, sf), *COLUMNS)
    assert got == sorted(brute(docs, items), key=repr) and any(r[3] for r in got)


def test_repeated_rows_in_several_parts(spark):
    docs = [(1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (1, "x"), (None, "b c d e f g h i j"), (None, None), (None, None)]
    items = [(i, t) for i, t in enumerate(["a b c d e f g h", "b c d e f g h i j", "x"])]
    got = D.contamination(spark, documents(spark, docs), spark.createDataFrame(items, ITEM), part_words=8)
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items") == sorted([(1, 9, 9, 2), (1, 9, 9, 2), (1, 1, 1, 1), (None, 9, 9, 1), (None, 0, 0, 0), (None, 0, 0, 0)], key=repr)


def test_messy_rows(spark, messy):
    items = spark.createDataFrame([(1, prose(2, 40)), (None, prose(1, 80)), (2, None), (3, "one two"), (3, "one two")], ITEM).selectExpr("*", "'x' AS doc_id")
    got = rows_of(D.contamination(spark, messy, items), "doc_id", "n_words", "n_hit", "n_items")
    assert (100, 120, 40, 1) in got and (7, 2, 2, 1) in got and (3, 0, 0, 0) in got and len(got) == messy.count()
    clean = D.drop_contaminated(spark, messy, items)
    assert clean.columns == messy.columns and clean.count() == messy.count() - 3
    assert D.drop_contaminated(spark, messy, items.where("false")).count() == messy.count()
    assert D.contamination(spark, messy.where("false"), items).count() == 0


def test_a_full_part_fits_a_worker():
    code = """
import random, resource
from vecspark.llm import decontaminate as D
r = random.Random(1)
words = [f"w{r.randrange(10**6)}" for _ in range(D.PATTERN_WORDS)]
texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]
del words
(m,) = D.matchers(texts, 8)
assert len(m.hash) > 0.95 * D.PATTERN_WORDS and (m.shift == 0).mean() < 0.3
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(D.__file__).parents[2], check=True)
    assert int(got.stdout) < 1024
