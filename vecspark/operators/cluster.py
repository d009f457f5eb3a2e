"""Incremental clustering and its parallel parts.

Assignment is order-dependent: each item sees the clusters that the items before it made.
It is a fold over the items' order, run for each group (a data set, a tenant, a partition) by
one task; groups run in parallel. Thresholds, merge proposals and statistics are plain
expressions. Cluster ids are the ids of first members, not clock readings, so results
repeat. Neighbours for the vote are exact, not approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import kernels

THRESHOLD = 0.3
MIN_SIZE = 2
NEIGHBOURS = 5
f32 = np.float32


class _Rows:
    """Vectors as the rows of one array that grows, and their most similar ones.

    A product in single precision, within `slack` of the similarity, leaves the few that are scored as kernels.scores() has it.
    """

    def __init__(self, vectors: list[np.ndarray]):
        self.x, self.n, self.norm = np.stack(vectors) if vectors else None, len(vectors), 0.0
        for v in vectors:
            self._longest(v)

    def _longest(self, v: np.ndarray) -> None:
        norm = math.sqrt(np.dot(v, v)) if v.dtype == f32 else math.nan
        self.norm = norm if not norm <= self.norm and not math.isnan(self.norm) else self.norm

    def put(self, at: int, v: np.ndarray) -> None:
        if self.x is None:
            self.x = np.zeros((16, len(v)), v.dtype)
        if v.shape != self.x.shape[1:]:
            raise ValueError(f"dimensions differ: {v.shape} and {self.x.shape[1:]}")
        if at == len(self.x):
            self.x = np.concatenate([self.x, np.zeros_like(self.x)])
        self.x[at] = v
        self.n = max(self.n, at + 1)
        self._longest(v)

    def best(self, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order, among them the k most similar ones and all as similar, and their similarities."""
        x = self.x[: self.n]
        bound = self.norm * math.sqrt(np.dot(v, v))
        at = np.arange(self.n)
        if k < self.n and bound < 1e15 and v.shape == x.shape[1:]:  # not with NaN
            s = x @ v
            least = s.max() if k == 1 else np.partition(s, self.n - k)[self.n - k]
            at = np.flatnonzero(s >= least - f32((len(v) + 8) * 2.0**-21 * bound + 1e-36))
        return at, kernels.scores(x[at], v[None, :])[:, 0]


class _Sum:
    """The exact sum of single-precision numbers of which some come and go; NaN or infinite while one of them is."""

    def __init__(self, values: list[np.float32]):
        self.total, self.n, self.odd = 0, 0, []
        for v in values:
            self.change(v, 1)

    def change(self, v: np.float32, sign: int) -> None:
        self.n += sign
        if math.isfinite(v):
            self.total += sign * int(math.ldexp(float(v), 149))
        elif sign > 0:
            self.odd.append(float(v))
        else:
            self.odd.pop(next(i for i, o in enumerate(self.odd) if o == v or (math.isnan(o) and math.isnan(v))))

    def mean(self) -> np.float32:
        return f32((self.total / (1 << 149) + sum(self.odd)) / self.n) if self.n else f32(0)


@dataclass
class Clusters:
    """State of the fold; it goes on from call to call."""

    threshold: float = THRESHOLD
    min_size: int = MIN_SIZE
    top_k: int = NEIGHBOURS
    ids: list[int] = field(default_factory=list)
    protos: list[np.ndarray] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    mean: list[np.float32] = field(default_factory=list)
    std: list[np.float32] = field(default_factory=list)
    labels: list[str | None] = field(default_factory=list)
    assigned: dict[int, int] = field(default_factory=dict)
    seen_ids: list[int] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)

    def averages(self) -> tuple[float, float, float]:
        many = [i for i, n in enumerate(self.size) if n > 1]
        mean = lambda x: f32(sum(map(float, x)) / len(x)) if x else f32(0)
        return mean([self.mean[i] for i in many]), mean(self.size), mean([self.std[i] for i in many])

    def limit(self, c: int, cohesion: float, min_size: int) -> np.float32:
        """The similarity that cluster c asks for."""
        return adaptive_threshold(self.size[c], self.mean[c], self.std[c], cohesion, min_size, self.threshold)

    def smallest(self, batch: int) -> int:
        return max(max(2, int(math.sqrt(batch))) if batch > 0 else 2, self.min_size)

    def _vote(self, v: np.ndarray, cohesion: float, min_size: int, near: list[int], place: dict[int, int]) -> int | None:
        votes: dict[int, list[np.float32]] = {}
        for item in near:
            c = place.get(self.assigned.get(item, -1))
            if c is not None:
                votes.setdefault(c, []).append(kernels.dot(v, self.protos[c]))
        if not votes:
            return None
        most = max(map(len, votes.values()))
        top = [c for c, s in votes.items() if len(s) == most]
        best = top[0] if len(top) == 1 else max(top, key=lambda c: f32(sum(map(float, votes[c])) / len(votes[c])))
        if most < self.top_k // 2:
            return None
        return best if kernels.dot(v, self.protos[best]) >= self.limit(best, cohesion, min_size) else None

    def _nearest(self, v: np.ndarray, seen: _Rows) -> list[int]:
        if not self.seen:
            return []
        at, s = seen.best(v, self.top_k)
        return [self.seen_ids[i] for i in at[np.argsort(-s, kind="stable")[: self.top_k]]]

    def add(self, items: list[tuple[int, np.ndarray]]) -> None:
        """Takes a batch of (id, vector) in order; the batch's size sets the smallest settled cluster."""
        min_size = self.smallest(len(items))
        protos, seen = _Rows(self.protos), _Rows(self.seen)
        place = {cid: i for i, cid in enumerate(self.ids)}
        means = _Sum([m for m, n in zip(self.mean, self.size, strict=True) if n > 1])
        for item, v in items:
            v = np.asarray(v, f32)
            chosen = None
            if self.ids:
                cohesion = means.mean()
                at, sims = protos.best(v, 1)
                best = int(sims.argmax())
                near = int(at[best])
                chosen = near if sims[best] >= self.limit(near, cohesion, min_size) else self._vote(v, cohesion, min_size, self._nearest(v, seen), place)
            if chosen is None:
                chosen = place[item] = len(self.ids)
                self.ids.append(item)
                self.protos.append(v)
                self.size.append(1)
                self.mean.append(f32(self.threshold))
                self.std.append(f32(0))
                self.labels.append(None)
                self.assigned[item] = item
            else:
                if self.size[chosen] > 1:
                    means.change(self.mean[chosen], -1)
                self._join(chosen, item, v)
                if self.size[chosen] > 1:
                    means.change(self.mean[chosen], 1)
            protos.put(chosen, self.protos[chosen])
            seen.put(len(self.seen), v)
            self.seen_ids.append(item)
            self.seen.append(v)

    def _join(self, c: int, item: int, v: np.ndarray) -> None:
        n, mean, std = self.size[c], self.mean[c], self.std[c]
        self.protos[c], self.size[c] = kernels.update_prototype(self.protos[c], v[None, :], n)
        s = kernels.dot(self.protos[c], v)
        self.mean[c] = f32((mean * f32(n) + s) / f32(n + 1)) if n >= 1 else s
        spread = f32(f32(n - 1) * f32(std * std) + f32(s - mean) * f32(s - self.mean[c]))
        self.std[c] = f32(math.sqrt(max(float(f32(spread / f32(n))), 0.0))) if n > 1 else f32(0)
        self.assigned[item] = self.ids[c]

    def merge_limit(self) -> float:
        cohesion, _, std = self.averages()
        return max(f32(self.threshold), f32(cohesion - std))

    def merges(self) -> dict[int, list[int]]:
        return similar_clusters(self.ids, np.stack(self.protos), self.merge_limit()) if self.ids else {}

    def clear(self) -> None:
        self.__init__(self.threshold, self.min_size, self.top_k)


def adaptive_threshold(size: int, mean: float, std: float, cohesion: float, min_size: int, threshold: float = THRESHOLD) -> np.float32:
    base = f32(f32(threshold) * f32(1 - f32(math.exp(-size))))
    if size < min_size or cohesion <= 0:
        return base
    x = f32((f32(mean) - f32(cohesion)) / max(f32(1e-6), f32(cohesion)))
    alpha = f32(1 / f32(1 + f32(math.exp(-x))))
    high = max(f32(f32(mean) - f32(std)), base)
    return f32(f32(alpha * high) + f32(f32(1 - alpha) * base))


def threshold_column(size: Column, mean: Column, std: Column, cohesion: Column, min_size: int, threshold: float = THRESHOLD) -> Column:
    """adaptive_threshold() as a column, in double precision."""
    base = F.lit(threshold) * (1 - F.exp(-size.cast("double")))
    x = (mean.cast("double") - cohesion) / F.greatest(F.lit(1e-6), cohesion)
    alpha = 1 / (1 + F.exp(-x))
    high = F.greatest(mean.cast("double") - std.cast("double"), base)
    return F.when((size < min_size) | (cohesion <= 0), base).otherwise(alpha * high + (1 - alpha) * base)


def similar_clusters(ids: list[int], protos: np.ndarray, limit: float) -> dict[int, list[int]]:
    """For each cluster the others at least so similar, most similar first; only those that have some."""
    s = kernels.scores(protos, protos)
    np.fill_diagonal(s, f32(0))
    out = {}
    for i, row in enumerate(s):
        j = np.flatnonzero(row >= f32(limit))
        if len(j):
            out[ids[i]] = [ids[x] for x in j[np.argsort(-row[j], kind="stable")]]
    return out


def merge_proposals(spark: SparkSession, clusters: DataFrame, limit: float = 0.9) -> DataFrame:
    """(cluster_id, target, sim, rank): pairs of clusters at least so similar, symmetric, not applied.

    Prototypes go out in blocks of bounded size; only pairs over the limit come back. A
    cluster's similarity with itself counts as 0, so a limit of 0 or less lists it too.
    """
    from vecspark.operators.search import QUERY_BYTES

    n, width = clusters.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = int(n * (4 * width + 8) // QUERY_BYTES) + 1
    out = None
    for block in range(blocks):
        part = clusters if blocks == 1 else clusters.where(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == block)
        got = part.select("cluster_id", "embedding").toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(got.column(0)), kernels.matrix(got.column(1))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            other, q = sent.value
            for b in batches:
                if not len(other) or not b.num_rows:
                    continue
                own = np.asarray(b.column(0))
                s = kernels.scores(kernels.matrix(b.column(1)), q)
                s = np.where(own[:, None] == other[None, :], f32(0), s)
                i, j = np.nonzero(s >= f32(limit))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(other[j]), pa.array(s[i, j])], names=["cluster_id", "target", "sim"])

        one = clusters.select("cluster_id", "embedding").mapInArrow(run, "cluster_id long, target long, sim float")
        out = one if out is None else out.unionAll(one)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("sim"), "target")) - 1
    return out.withColumn("rank", rank.cast("int"))


_MEMBER = "grp string, item_id long, cluster_id long"


def assign_incrementally(items: DataFrame, group: str | None = None, order: str = "item_id", threshold: float = THRESHOLD, min_size: int = MIN_SIZE, top_k: int = NEIGHBOURS) -> DataFrame:
    """(grp, item_id, cluster_id): the fold over items (item_id, embedding) by group, in order.

    Each group is one sequential pass, as the result of an item depends on all before it;
    without a group all items form one.
    """
    rows = items.select(
        (F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.col("item_id").cast("long").alias("item_id"), F.col(order).cast("long").alias("ord"), "embedding"
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "item_id"])
        state = Clusters(threshold, min_size, top_k)
        state.add(list(zip(pdf["item_id"].tolist(), map(np.asarray, pdf["embedding"]), strict=True)))
        return pd.DataFrame({"grp": pdf["grp"], "item_id": pdf["item_id"], "cluster_id": [state.assigned[i] for i in pdf["item_id"]]})

    return rows.groupBy("grp").applyInPandas(fold, _MEMBER)


def clusters_of(items: DataFrame, group: str | None = None, order: str = "item_id", threshold: float = THRESHOLD, min_size: int = MIN_SIZE, top_k: int = NEIGHBOURS) -> DataFrame:
    """(grp, cluster_id, embedding, prototype_size, mean_similarity, std_similarity, label) of the same fold."""
    rows = items.select(
        (F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.col("item_id").cast("long").alias("item_id"), F.col(order).cast("long").alias("ord"), "embedding"
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "item_id"])
        s = Clusters(threshold, min_size, top_k)
        s.add(list(zip(pdf["item_id"].tolist(), map(np.asarray, pdf["embedding"]), strict=True)))
        return pd.DataFrame(
            {"grp": pdf["grp"].iloc[0], "cluster_id": s.ids, "embedding": [p.tolist() for p in s.protos], "prototype_size": s.size, "mean_similarity": s.mean, "std_similarity": s.std, "label": s.labels}
        )

    return rows.groupBy("grp").applyInPandas(fold, "grp string, cluster_id long, embedding array<float>, prototype_size int, mean_similarity float, std_similarity float, label string")
