import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from vecspark import kernels
from vecspark import schema as S
from vecspark.operators import search as Q
from vecspark.operators.ann import IvfIndex, recall
from vecspark.operators.store import EmbeddingStore

ROW = "id long, date long, embedding array<float>"
QROW = "id long, date long, embedding array<tinyint>"


def rows(spark, ids, dim=8, dates=None, seed=0):
    rng = np.random.default_rng(seed)
    made = [(int(i), (dates or {}).get(i, (i + 1) * 100), rng.normal(size=dim).astype(np.float32).tolist()) for i in ids]
    return spark.createDataFrame(made, ROW)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return EmbeddingStore(spark, f"file://{tmp_path}/store", 8)


def test_round_trip_and_insert_if_absent(spark, store):
    assert not store.exists
    assert store.add(rows(spark, [1, 2])) == 2 and store.exists
    assert store.add(rows(spark, [2, 3])) == 1
    assert ids(store.get()) == [1, 2, 3]
    again = EmbeddingStore(spark, store.path, 8)
    assert ids(again.get()) == [1, 2, 3]


def test_duplicates_in_one_insert_are_counted_and_the_last_stays(spark, store):
    r = rows(spark, [1]).unionAll(rows(spark, [1], dates={1: 999})).coalesce(1)
    assert store.add(r) == 2
    assert [x["date"] for x in store.get().collect()] == [999]


def test_update_changes_only_known_ids(spark, store):
    store.add(rows(spark, [1, 2]))
    assert store.update(rows(spark, [1, 3], dates={1: 999, 3: 300})) == 1
    assert {r["id"]: r["date"] for r in store.get().collect()} == {1: 999, 2: 300}


def test_remove_and_empty_store(spark, store):
    store.add(rows(spark, [1, 2, 3]))
    assert store.remove([2, 9, 2]) == 1
    assert ids(store.get()) == [1, 3]
    assert store.remove([1, 3]) == 2
    store.save()
    assert ids(EmbeddingStore(spark, store.path, 8).get()) == []


def test_add_clear_remove_save(spark, store):
    store.add(rows(spark, [1, 2]))
    store.load()
    store.clear()
    store.add(rows(spark, [3, 4]))
    store.remove([3])
    store.save()
    assert ids(EmbeddingStore(spark, store.path, 8).get()) == [1, 2, 4]


def test_point_lookup_keeps_the_order_asked_for(spark, store):
    store.add(rows(spark, [1, 2, 3]))
    assert [r["id"] for r in store.get([3, 9, 1, 3]).collect()] == [3, 1, 3]


def test_wrong_rows_write_nothing(spark, store):
    with pytest.raises(S.InvalidEmbeddingDimension):
        store.add(rows(spark, [1], dim=2))
    with pytest.raises(S.InvalidEmbeddingType):
        store.add(spark.createDataFrame([(1, 1, [1] * 8)], QROW))
    assert not store.exists


def test_query_checks_and_self_match(spark, store):
    store.add(rows(spark, [1, 2, 3]))
    v = [float(x) for x in store.get([1]).first()["embedding"]]
    unit = (np.array(v) / np.linalg.norm(v) ** 2).tolist()
    got = store.query(unit, 1, 0.8, sims=True).collect()
    assert [r["id"] for r in got] == [1] and got[0]["sim"] == pytest.approx(1, abs=1e-5)
    assert store.query(v, 1, 0.0).columns == ["rank", "id"]
    with pytest.raises(S.InvalidEmbeddingDimension):
        store.query([1.0], 1)
    with pytest.raises(S.InvalidEmbeddingType):
        store.query(v, 1, encoding="qint8")
    assert store.query([1.0], 1, start=10**9).collect() == []  # nothing to search comes before the checks


def test_filters_ties_and_threshold(spark):
    r = spark.createDataFrame([(i, i * 10, [1.0, 0.0]) for i in range(5)] + [(9, 90, [0.5, 0.0]), (10, 5, [float("nan"), 0.0])], ROW)
    take = lambda **k: [x["id"] for x in Q.search(r, [1.0, 0.0], **k).orderBy("rank").collect()]
    assert take(k=3) == [0, 1, 2]
    assert take(k=9, threshold=0.5) == [0, 1, 2, 3, 4, 9]
    assert take(k=9, ids=[4, 9, 77]) == [4, 9] and take(k=2, ids=[]) == [0, 1]
    assert take(k=9, start=20, end=40) == [2, 3, 4]
    assert take(k=0) == []
    with pytest.raises(ValueError):
        Q.search(r, [1.0, 0.0], -1)


def test_quantised_search(spark):
    r = spark.createDataFrame([(1, 1, [127, 0]), (2, 1, [0, 127])], QROW)
    assert [(x["id"], x["sim"]) for x in Q.search(r, [127, 0], 2, 0.5, sims=True).collect()] == [(1, 1.0)]
    with pytest.raises(S.InvalidEmbeddingType):
        Q.search(r, [0.5, 0.1], 1)


def test_batch_search_equals_single_searches(spark, monkeypatch):
    data = rows(spark, range(300), seed=4).cache()
    queries = rows(spark, range(7), seed=4).selectExpr("id AS qid", "embedding")
    want = []
    for q in queries.collect():
        want += [(q["qid"], x["rank"], x["id"], x["sim"]) for x in Q.search(data, [float(v) for v in q["embedding"]], 5, 0.1, sims=True).collect()]
    got = lambda: sorted(tuple(x) for x in Q.batch_search(spark, data.repartition(5), queries, 5, 0.1).collect())
    assert got() == sorted(want)
    monkeypatch.setattr(Q, "QUERY_BYTES", 64)  # several blocks
    assert got() == sorted(want)


def test_filter_reaches_the_scan(spark, sf, tmp_path):
    rows(spark, range(50)).write.parquet(f"{tmp_path}/t")
    plan = Q.search(spark.read.parquet(f"{tmp_path}/t"), [0.0] * 8, 3, start=5, end=9)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert "GreaterThanOrEqual(date,5), LessThanOrEqual(date,9)" in pushed and "TakeOrderedAndProject" in plan


def test_ivf_recall_add_and_save(spark, tmp_path):
    data = rows(spark, range(400), dim=16, seed=9).selectExpr("id", "embedding").cache()
    q = data.where("id < 20").selectExpr("id AS qid", "embedding")
    exact = Q.batch_search(spark, data, q, 5, threshold=-100)
    index = IvfIndex.build(spark, data, 16)
    full = index.query(q, 5, 16)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in full.collect()) == sorted((r["qid"], r["rank"], r["id"]) for r in exact.collect())
    assert recall(exact, index.query(q, 5, 10)).agg({"recall": "avg"}).first()[0] >= 0.9
    index.save(f"{tmp_path}/ivf")
    assert IvfIndex.load(spark, f"{tmp_path}/ivf").query(q, 5, 16).count() == 100
    more = index.add(data.where("id = 0").selectExpr("id + 1000 AS id", "embedding"))
    top = more.query(q.where("qid = 0"), 2, 16).orderBy("rank").collect()
    assert {r["id"] for r in top} == {0, 1000}
    assert index.query(q.where("qid = 1"), 1000, 16).count() == 400  # no padding


def test_a_crash_before_the_commit_leaves_the_version_before(spark, store, monkeypatch):
    store.add(rows(spark, [1, 2]))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(EmbeddingStore, "_commit", crash)
        for change in (lambda: store.add(rows(spark, [3])), lambda: store.remove([1]), store.save):
            with pytest.raises(OSError):
                change()
    assert ids(EmbeddingStore(spark, store.path, 8).get()) == [1, 2]
    assert store.add(rows(spark, [2, 3])) == 1 and ids(EmbeddingStore(spark, store.path, 8).get()) == [1, 2, 3]


def test_changes_add_parts_and_are_compacted(spark, store, monkeypatch):
    from vecspark.operators import store as module

    store.add(rows(spark, range(10)))
    store.remove([1, 2])
    store.add(rows(spark, [2]))
    assert store.update(rows(spark, [3, 99]).selectExpr("id", "id + 5000 AS date", "embedding")) == 1
    assert ids(store.get()) == [0, 2, 3, 4, 5, 6, 7, 8, 9] and store.get([3]).first()["date"] == 5003
    assert [kind for kind, _ in store._parts()[1]] == ["rows", "gone", "rows", "gone", "rows"]
    assert [r["id"] for r in store.get().orderBy("_seq").collect()] == [0, 3, 4, 5, 6, 7, 8, 9, 2]
    monkeypatch.setattr(module, "COMPACT", 5)
    store.remove([0])
    assert [kind for kind, _ in store._parts()[1]] == ["rows"] and ids(store.get()) == [2, 3, 4, 5, 6, 7, 8, 9]


def test_two_writers_do_not_undo_each_other(spark, store):
    store.add(rows(spark, [1]))
    before, parts = store._parts()
    store.add(rows(spark, [2]))
    with pytest.raises(RuntimeError):
        store._commit(before, parts)
    assert ids(store.get()) == [1, 2]


def test_best_equals_scoring_all_pairs(monkeypatch):
    monkeypatch.setattr(kernels, "ROWS", 50)
    monkeypatch.setattr(kernels, "CELLS", 600)
    monkeypatch.setattr(kernels, "WAITING", 40)
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 8)).astype(np.float32), rng.normal(size=(30, 8)).astype(np.float32)
    x[100:130], q[4] = x[7], x[7]  # ties
    odd, odd_q = x.copy(), q.copy()
    odd[3], odd[60, 2], odd[61, 2], odd[200], odd[201], odd_q[5], odd_q[6, 1] = np.nan, np.inf, -np.inf, 1e30, 1e-30, np.nan, 3e38
    cases = [(x, q), (odd, odd_q), (kernels.quantize(x / 5), kernels.quantize(q / 5)), (x.astype(np.float64), q.astype(np.float64))]
    ids, order = np.arange(400), rng.permutation(400)
    for rows, asked in cases:
        with np.errstate(all="ignore"):
            s = kernels.scores(rows, asked)
        for k, threshold, nan_first in ((5, 0.1, False), (3, -np.inf, True), (1000, -1.0, False), (0, 0.0, False)):
            best = kernels.Best(asked, k, threshold, nan_first)
            for at in range(0, 400, 130):
                best.add(ids[at : at + 130], order[at : at + 130], rows[at : at + 130])
            got = best.result()
            for j in range(len(asked)):
                use = [i for i in range(400) if s[i, j] >= np.float32(threshold) or (nan_first and np.isnan(s[i, j]))]
                use.sort(key=lambda i: (-np.inf if np.isnan(s[i, j]) else -s[i, j], not np.isnan(s[i, j]), order[i]))
                own = got[0] == j
                assert got[1][own].tolist() == use[:k] and np.array_equal(got[3][own], s[use[:k], j], equal_nan=True)


def test_batch_search_holds_no_row_for_each_query():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4096, 4)).astype(np.float32), rng.normal(size=(8000, 4)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(np.arange(4096)), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "__order", "embedding"])
    tracemalloc.start()
    try:
        got = sum(b.num_rows for b in Q._best(SimpleNamespace(value=(np.arange(8000), q)), 3, np.float32(-9e9))([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == 24_000 and peak < 128 << 20  # the similarities of all pairs take 512 MB


def test_ivf_makes_no_row_of_a_pair(spark):
    data = rows(spark, range(60), dim=8, seed=2).selectExpr("id", "embedding")
    index = IvfIndex.build(spark, data, 6)
    found = index.query(data.selectExpr("id AS qid", "embedding"), 3, 4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    c, v = index.centroids, {r["id"]: np.float32(r["embedding"]) for r in data.collect()}
    near = {i: (x @ c.T).argmax() for i, x in v.items()}
    for qid, x in v.items():
        lists = set(np.argsort(-(x @ c.T), kind="stable")[:4])
        sim = {i: kernels.dot(y, x) for i, y in v.items() if near[i] in lists}
        assert [r["id"] for r in found.where(f"qid = {qid}").orderBy("rank").collect()] == sorted(sim, key=lambda i: (-sim[i], i))[:3]
        if qid == 4:
            break
