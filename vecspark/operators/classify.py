"""Few-shot classification against class prototypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark import kernels
from vecspark.functions import vector as V
from vecspark.schema import Encoding, InvalidEmbeddingType

#: Bytes of prototypes that one broadcast may carry; more are sent in blocks.
PROTOTYPE_BYTES = 32 << 20


def few_shot(spark: SparkSession, items: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(item_id, class_id, similarity) of items (item_id, embedding).

    A prototype (cluster_id, embedding, mean_similarity, std_similarity[, seq]) accepts an
    item whose similarity reaches its mean minus its deviation; the most similar one that
    accepts wins, the first by seq (else cluster_id) on a tie. Nobody accepts: class null,
    similarity -1. Both sides must have one encoding.
    """
    kinds = [Encoding.of(d.schema["embedding"].dataType) for d in (items, prototypes)]
    if kinds[0] is not kinds[1]:
        raise InvalidEmbeddingType(f"items are {kinds[0].value}, prototypes {kinds[1].value}")
    seq = "seq" if "seq" in prototypes.columns else "cluster_id"
    floor = (F.col("mean_similarity").cast("float") - F.col("std_similarity").cast("float")).cast("float")
    own = prototypes.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.col(seq).cast("long").alias("seq"), "embedding", floor.alias("floor"))
    size = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = int(size[0] * (size[1] * kinds[0].width + 24) // PROTOTYPE_BYTES) + 1
    out = None
    for block in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == block)
        got = part.orderBy("seq", "cluster_id").toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(got.column(0)), np.asarray(got.column(1)), kernels.matrix(got.column(2)), np.asarray(got.column(3))))
        one = items.select(F.col("item_id").cast("long").alias("item_id"), "embedding").mapInArrow(_classify(sent), "item_id long, class_id long, similarity float, seq long")
        out = one if out is None else out.unionAll(one)
    if blocks > 1:
        best = F.max_by(F.struct("class_id", "similarity"), F.struct("similarity", (-F.col("seq")).alias("first")))
        out = out.groupBy("item_id").agg(best.alias("b")).select("item_id", "b.class_id", "b.similarity")
    return out.select("item_id", "class_id", "similarity")


def _classify(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seq, protos, floor = sent.value
        for b in batches:
            n = b.num_rows
            if not len(ids) or not n:
                best, sim = np.full(n, -1), np.full(n, -1, np.float32)
            else:
                s = kernels.scores(kernels.matrix(b.column(1)), protos)
                s = np.where((s >= floor) & (s > np.float32(-1)), s, np.float32(-np.inf))
                best = s.argmax(axis=1)  # the first of equals
                sim = s[np.arange(n), best]
                best = np.where(np.isneginf(sim), -1, best)
                sim = np.where(best < 0, np.float32(-1), sim)
            none = best < 0
            pick = np.maximum(best, 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids[pick] if len(ids) else np.zeros(n, np.int64), mask=none), pa.array(sim.astype(np.float32)), pa.array(seq[pick] if len(ids) else np.zeros(n, np.int64), mask=none)],
                names=["item_id", "class_id", "similarity", "seq"],
            )

    return run


def class_prototypes(items: DataFrame, key: str, order: str, vector: str = "embedding") -> DataFrame:
    """Prototypes by class with the mean and deviation of their members' similarities."""
    from vecspark.operators.aggregates import prototypes

    protos = prototypes(items, key, order, vector)
    members = items.select(F.col(key), F.col(order).alias("__order"), F.col(vector).alias("__v")).join(protos, key)
    sims = members.select(key, "n", "__order", V.dot("__v", "embedding").cast("double").alias("s"))
    # sums in a fixed order, so that results do not depend on partitioning
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__order", "s"))), lambda x: x["s"])
    stats = sims.groupBy(key, "n").agg(ordered.alias("sims"))
    total = F.aggregate("sims", F.lit(0.0), lambda t, x: t + x)
    mean = stats.withColumn("mean", total / F.col("n"))
    var = F.aggregate("sims", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean"))) / F.col("n")
    stats = mean.select(key, F.col("mean").cast("float").alias("mean_similarity"), F.sqrt(var).cast("float").alias("std_similarity"))
    return protos.join(stats, key).select(F.col(key).cast("long").alias("cluster_id"), "embedding", F.col("n").alias("prototype_size"), "mean_similarity", "std_similarity", F.lit(None).cast("string").alias("label"))
