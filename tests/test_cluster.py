import math

import numpy as np
import pytest

from vecspark import kernels
from vecspark.operators import aggregates as A
from vecspark.operators import classify as C
from vecspark.operators import cluster as K
from vecspark.schema import InvalidEmbeddingType
from vecspark.streaming.clusterer import StreamClusterer

CLUSTER = "cluster_id long, embedding array<float>, prototype_size int, mean_similarity float, std_similarity float"


def groups(n=30, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = np.eye(dim, dtype=np.float32)[:3]
    return [(i, kernels.normalize(centres[i % 3] + rng.normal(scale=0.05, size=dim).astype(np.float32))) for i in range(n)]


def frame(spark, items):
    return spark.createDataFrame([(i, v.tolist()) for i, v in items], "item_id long, embedding array<float>")


def test_separable_groups_become_clusters(spark):
    got = {r["item_id"]: r["cluster_id"] for r in K.assign_incrementally(frame(spark, groups())).collect()}
    assert got == {i: i % 3 for i in range(30)}
    clusters = K.clusters_of(frame(spark, groups())).collect()
    assert sorted((c["cluster_id"], c["prototype_size"]) for c in clusters) == [(0, 10), (1, 10), (2, 10)]


def test_state_goes_on_between_calls():
    s = K.Clusters()
    items = groups()
    s.add(items[:10])
    s.add(items[10:])
    assert s.assigned == {i: i % 3 for i in range(30)} and s.size == [10, 10, 10]
    s.clear()
    assert not s.ids and not s.assigned


def test_running_statistics():
    s = K.Clusters()
    a, b, c = np.float32([1, 0]), kernels.normalize(np.float32([1, 0.1])), kernels.normalize(np.float32([1, -0.1]))
    s.add([(0, a), (1, b), (2, c)])
    p1, _ = kernels.update_prototype(a, b[None], 1)
    s1 = kernels.dot(p1, b)
    m1 = (0.3 + s1) / 2
    p2, _ = kernels.update_prototype(p1, c[None], 2)
    s2 = kernels.dot(p2, c)
    m2 = (m1 * 2 + s2) / 3
    assert s.mean[0] == pytest.approx(m2, abs=1e-6)
    assert s.std[0] == pytest.approx(math.sqrt((s2 - m1) * (s2 - m2) / 2), abs=1e-5)


def strict_and_lenient(neighbours):
    """Cluster 100 is nearest to the item but, far above the mean cohesion, strict; cluster 200 is lenient."""
    s = K.Clusters(top_k=4)
    low = [300, 301, 302, 303, 304, 305, 306, 307, 308]
    s.ids = [100, 200, *low]
    s.protos = [np.float32([1, 0]), np.float32([0.8, 0.6]), *[np.float32([-1, 0])] * len(low)]
    s.size, s.labels = [50, 1, *[50] * len(low)], [None] * (2 + len(low))
    s.mean = [np.float32(0.999), np.float32(0.3), *[np.float32(0.01)] * len(low)]
    s.std = [np.float32(0)] * (2 + len(low))
    v = kernels.normalize(np.float32([1, 0.3]))
    s.seen_ids, s.seen, s.assigned = neighbours, [v] * len(neighbours), dict.fromkeys(neighbours, 200)
    s.add([(9, v)])
    return s


def test_vote_wins_where_the_best_cluster_refuses():
    assert strict_and_lenient([1, 2, 3]).assigned[9] == 200
    assert strict_and_lenient([1]).assigned[9] == 9  # too few votes


def test_adaptive_threshold():
    base = 0.3 * (1 - math.exp(-1))
    assert K.adaptive_threshold(1, 0.9, 0.1, 0.5, 2) == pytest.approx(base, abs=1e-6)
    assert K.adaptive_threshold(5, 0.9, 0.1, 0.0, 2) == pytest.approx(0.3 * (1 - math.exp(-5)), abs=1e-6)
    b = 0.3 * (1 - math.exp(-5))
    alpha = 1 / (1 + math.exp(-(0.9 - 0.5) / 0.5))
    assert K.adaptive_threshold(5, 0.9, 0.1, 0.5, 2) == pytest.approx(alpha * 0.8 + (1 - alpha) * b, abs=1e-6)


def test_batch_size_sets_the_smallest_cluster():
    assert K.Clusters().smallest(4) == 2 and K.Clusters().smallest(100) == 10 and K.Clusters(min_size=30).smallest(100) == 30


def test_merge_proposals(spark):
    ids, protos = [1, 2, 3], np.float32([[1, 0], [0.96, 0.28], [0, 1]])
    assert K.similar_clusters(ids, protos, 0.9) == {1: [2], 2: [1]}
    assert K.similar_clusters(ids, protos, 0.0)[3] == [2, 1, 3]  # its own similarity counts as 0; ties keep their order
    c = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, protos, strict=True)], "cluster_id long, embedding array<float>")
    assert sorted((r["cluster_id"], r["target"]) for r in K.merge_proposals(spark, c, 0.9).collect()) == [(1, 2), (2, 1)]


def test_averages(spark):
    c = spark.createDataFrame([(1, [1.0], 1, 0.3, 0.0), (2, [1.0], 3, 0.8, 0.1), (3, [1.0], 2, 0.6, 0.3)], CLUSTER)
    assert tuple(A.cluster_averages(c).first()) == pytest.approx((0.7, 2.0, 0.2))
    assert tuple(A.cluster_averages(c.where("false")).first()) == (0, 0, 0)


def test_few_shot(spark, monkeypatch):
    protos = spark.createDataFrame([(1, [1.0, 0.0], 5, 0.9, 0.1), (2, [1.0, 0.0], 5, 0.9, 0.1), (3, [0.0, 1.0], 5, 0.99, 0.0), (4, [-1.0, 0.0], 5, -2.0, 0.0)], CLUSTER)
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 0.9]), (3, [0.0, 1.0]), (4, [3.0, 0.0])], "item_id long, embedding array<float>")
    want = {1: (1, 1.0), 2: (4, np.float32(-0.1)), 3: (3, 1.0), 4: (1, 3.0)}
    got = lambda: {r["item_id"]: (r["class_id"], r["similarity"]) for r in C.few_shot(spark, items, protos).collect()}
    assert got() == want
    monkeypatch.setattr(C, "PROTOTYPE_BYTES", 32)  # several blocks
    assert got() == want
    none = C.few_shot(spark, items.where("item_id = 2"), protos.where("cluster_id = 3")).first()
    assert (none["class_id"], none["similarity"]) == (None, -1)
    assert C.few_shot(spark, items, protos.where("false")).where("class_id IS NULL").count() == 4
    with pytest.raises(InvalidEmbeddingType):
        C.few_shot(spark, items, protos.selectExpr("cluster_id", "array(1Y) AS embedding", "mean_similarity", "std_similarity"))


def test_prototypes_and_updates(spark):
    r = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [0.0, 5.0])], "k int, o int, embedding array<float>")
    got = {x["k"]: x["embedding"] for x in A.prototypes(r, "k", "o").collect()}
    assert got[1] == pytest.approx([2**-0.5] * 2) and got[2] == [0, 1]
    wide = {x["k"]: x["embedding"] for x in A.prototypes(r, "k", "o", wide_dim=2).collect()}
    assert wide[1] == pytest.approx(got[1])
    up = {x["k"]: (x["n"], x["embedding"]) for x in A.update_prototypes(A.prototypes(r, "k", "o"), r.where("k = 2"), "k", "o").collect()}
    assert up[2] == (2, [0, 1]) and up[1][0] == 2 and up[1][1] == got[1]


def test_stream_equals_calls(spark, tmp_path):
    items = groups(24)
    for n in range(3):
        frame(spark, items[n * 8 : n * 8 + 8]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("item_id long, embedding array<float>").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = StreamClusterer(f"{tmp_path}/state")
    q = sink.write(stream, f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert sink.state.assigned == {i: i % 3 for i in range(24)} and sink.batch == 2
    again = StreamClusterer(f"{tmp_path}/state")
    again(frame(spark, items), 2)  # a batch that was done before
    assert again.state.size == sink.state.size


def test_an_item_costs_no_full_scan_of_the_state(monkeypatch):
    rng = np.random.default_rng(0)
    items = list(enumerate(kernels.normalize(v) for v in rng.normal(size=(400, 6)).astype(np.float32)))
    items[130] = (130, items[10][1])
    scored, real = [], kernels.scores
    monkeypatch.setattr(kernels, "scores", lambda x, q: scored.append(len(x) * len(q)) or real(x, q))
    s = K.Clusters()
    s.add(items[:150])
    s.add(items[150:])
    assert sum(scored) < 20 * len(items)
    monkeypatch.setattr(K._Rows, "best", lambda self, v, k: (np.arange(self.n), real(self.x[: self.n], v[None, :])[:, 0]))
    full = K.Clusters()
    full.add(items[:150])
    full.add(items[150:])
    assert full.assigned == s.assigned and full.mean == s.mean and all(map(np.array_equal, full.protos, s.protos))


def test_running_mean_of_numbers_that_come_and_go():
    sums = K._Sum([np.float32(0.1), np.float32(0.7)])
    sums.change(np.float32("nan"), 1)
    assert math.isnan(sums.mean())
    sums.change(np.float32("nan"), -1)
    sums.change(np.float32(0.1), -1)
    assert sums.mean() == np.float32(0.7)
    sums.change(np.float32(0.7), -1)
    assert sums.mean() == 0
