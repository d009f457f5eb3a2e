import random
import re

import pytest

from llm_helpers import documents, prose, rows_of
from vecspark.llm import neardup as N
from vecspark.llm.common import Scratch, components


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """{doc_id: (n_shingles, component)} over unique ids."""
    sets = {i: word_set(t) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, r, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def check(spark, rows, percent=85):
    got = {r["doc_id"]: r for r in N.near_duplicates(spark, documents(spark, rows).repartition(5), percent).collect()}
    want = brute(rows, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())
    return want


def test_groups_chains_and_boundaries(spark):
    r = random.Random(11)
    rows, at = [], 0
    for g in range(12):
        base = prose(100 + g, r.randrange(30, 300))
        for _ in range(r.randrange(1, 9)):
            rows.append((at * 7 % 1009 + 1, edited(base, r, r.randrange(0, 5))))
            at += 1
    for g in range(6):  # chains: each a little further from the one before
        text = prose(300 + g, 200)
        for _ in range(6):
            text = edited(text, r, 2)
            rows.append((2000 + at, text))
            at += 1
    # 17 shared of 20 (0.85, linked) and 16 of 20 (not)
    words = [f"x{i}" for i in range(40)]
    rows += [(5000, " ".join(words[:22])), (5001, " ".join(words[:22] + ["y"] * 0)), (5002, " ".join(words[:21])), (5003, " ".join([*words[:21], "p", "q"]))]
    rows += [(6000, "Ab c"), (6001, "aB\tC"), (6002, ""), (6003, "   "), (6004, "ab c d"), (6005, "É x"), (6006, "é x")]
    want = check(spark, rows)
    assert want[6001][1] == 6000 and want[6006][1] == 6006 and want[6002] == (0, 6002)


def test_exact_threshold(spark):
    # sets of 20 shingles each that share 18 (18 / 22 < 0.85) or 19 (19 / 21 > 0.85)
    one = [f"a{i}" for i in range(24)]
    check(spark, [(1, " ".join(one)), (2, " ".join([*one[:23], "z"])), (3, " ".join([*one[:22], "y", "z"])), (4, " ".join([*one[:20], "s", "t", "u", "v"]))])
    # exactly 17 of 20: A has 17, B has those and 3 more
    b = [f"b{i}" for i in range(24)]
    want = check(spark, [(1, " ".join(b[:21])), (2, " ".join(b))])
    assert want[2] == (20, 1)


@pytest.mark.parametrize("blocks", [1024, 3])
def test_large_groups_leave_small_nodes(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "BLOCK_DOCS", blocks)
    r = random.Random(5)
    base, other = prose(1, 120), prose(2, 120)
    half = " ".join(base.split()[:60] + prose(3, 60).split())  # like base, not enough for a link
    rows = [(i, edited(base, r, 1)) for i in range(150)] + [(200 + i, edited(half, r, 1)) for i in range(100)] + [(400 + i, edited(other, r, 4)) for i in range(40)]
    rows += [(500 + i, base) for i in range(100)]
    check(spark, rows)


def test_whole_table_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.op2_minhash_neardup(spark, sf).collect()}
    assert got == brute(rows)


def test_messy_rows(spark, messy):
    got = rows_of(N.near_duplicates(spark, messy), "doc_id", "component_id", "kept")
    assert got.count((1, 1, True)) == 2 and (2, 1, False) in got and (3, 3, True) in got and (8, 7, False) in got and (6, 6, True) in got
    assert (None, 1, False) in got and (None, None, True) in got  # a row without id is linked but names no group
    kept = N.keep_one(spark, messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 1, 3, 4, 5, None, None, 6, 7, 9, 100], key=str)
    assert N.near_duplicates(spark, messy.where("false")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)]
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            low[y] = x
    got = components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {x: find(x) for x in list(low)}


def test_rows_that_share_an_id_keep_their_own_links(spark):
    n = prose(1, 400, 10**6).split()
    x = " ".join([*n[:398], "p", "q"])  # N~X
    y = " ".join([*n[:365], *prose(2, 35, 10**6).split()])  # Y~X no
    u = prose(3, 400, 10**6)
    for other in (y, u):
        rows = [(3, " ".join(n)), (5, x), (5, other), (9, other)]
        got = rows_of(N.near_duplicates(spark, documents(spark, rows).repartition(3)), "doc_id", "component_id", "kept")
        assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]


def test_repeated_rows_cost_no_pairs(spark):
    one, two = prose(1, 100, 10**6), prose(2, 100, 10**6)
    near = " ".join([*one.split()[:99], "z"])
    rows = [(7, one)] * 20_000 + [(8, near)] * 20_000 + [(9, two)]
    got = N.near_duplicates(spark, documents(spark, rows).repartition(4)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(7, 7, 20_000), (8, 7, 20_000), (9, 9, 1)]


def test_hot_keys_are_split(spark, monkeypatch):
    from vecspark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(6)
    base = prose(1, 120, 10**6)
    rows = [(i, edited(base, r, 1)) for i in range(60)] + [(200 + i, base) for i in range(60)] + [(400 + i, prose(50 + i, 60, 10**6)) for i in range(20)]
    check(spark, rows)
