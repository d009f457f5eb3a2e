"""Aggregates over vectors and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.functions import vector as V


def ordered_sum(vectors: Column) -> Column:
    """The elementwise single-precision sum of an array of vectors, from the first to the last."""
    first = F.element_at(vectors, 1)
    zeros = F.transform(first, lambda x: F.lit(0.0).cast("float"))
    return F.aggregate(vectors, zeros, lambda t, v: F.zip_with(t, v, lambda x, y: (x + y).cast("float")))


def _in_order(order: str, vector: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(vector).alias("v")))), lambda s: s["v"])


def sum_vectors(df: DataFrame, key: str, order: str, vector: str = "embedding") -> DataFrame:
    """(key, n, total): exact left-to-right single-precision sums by key, in the given order.

    The result does not depend on partitioning, but a key's vectors are gathered: use
    it where a key's group is bounded, and sum_vectors_wide() elsewhere.
    """
    return df.groupBy(key).agg(F.count("*").cast("int").alias("n"), ordered_sum(_in_order(order, vector)).alias("total"))


def sum_vectors_wide(df: DataFrame, key: str, dim: int, vector: str = "embedding") -> DataFrame:
    """(key, n, total) by map-side combined sums in double precision, rounded at the end.

    Nothing is gathered, so a key may hold any share of the rows; the last digit may differ
    from the ordered sum.
    """
    sums = [F.sum(F.get(vector, F.lit(i)).cast("double")).cast("float").alias(f"s{i}") for i in range(dim)]
    wide = df.groupBy(key).agg(F.count("*").cast("int").alias("n"), *sums)
    return wide.select(key, "n", F.array(*[f"s{i}" for i in range(dim)]).alias("total"))


def prototypes(df: DataFrame, key: str, order: str, vector: str = "embedding", wide_dim: int | None = None) -> DataFrame:
    """(key, n, embedding): the normalised mean vector of each key; wide_dim: use sum_vectors_wide()."""
    sums = sum_vectors_wide(df, key, wide_dim, vector) if wide_dim else sum_vectors(df, key, order, vector)
    mean = sums.select(key, "n", F.transform("total", lambda x: (x / F.col("n").cast("float")).cast("float")).alias("mean"))
    return mean.select(key, "n", V.normalize("mean").alias("embedding"))


def prototypes_q(df: DataFrame, key: str, order: str, vector: str = "embedding") -> DataFrame:
    """prototypes() over int8 vectors, quantised again."""
    floats = df.withColumn(vector, V.dequantize(vector))
    return prototypes(floats, key, order, vector).withColumn("embedding", V.quantize("embedding"))


def update_prototypes(old: DataFrame, new: DataFrame, key: str, order: str, vector: str = "embedding") -> DataFrame:
    """(key, n, embedding): prototypes (key, n, embedding) after the rows of new; keys without new rows stay."""
    sums = sum_vectors(new, key, order, vector).select(key, F.col("n").alias("__k"), "total")
    # inputs get names of their own: inside lambdas a name may resolve to an alias of the same select
    both = old.select(key, F.col("n").alias("__n"), F.col("embedding").alias("__p")).join(sums, key, "left")
    total = F.col("__n") + F.col("__k")

    def one(p: Column, s: Column) -> Column:
        base = F.when(F.col("__n") > 0, (F.col("__n").cast("float") * p).cast("float")).otherwise(F.lit(0.0).cast("float"))
        return ((base + s).cast("float") / total.cast("float")).cast("float")

    merged = V.normalize(F.zip_with("__p", "total", one))
    same = F.col("__k").isNull()
    return both.select(key, F.when(same, F.col("__n")).otherwise(total).cast("int").alias("n"), F.when(same, F.col("__p")).otherwise(merged).alias("embedding"))


def cluster_averages(clusters: DataFrame) -> DataFrame:
    """One row: mean cohesion and deviation over clusters of more than one member, mean size over all; 0 if there are none."""
    many = F.col("prototype_size") > 1
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).cast("float")
    return clusters.agg(
        mean(F.when(many, F.col("mean_similarity").cast("double"))).alias("avg_cohesion"),
        mean(F.col("prototype_size")).alias("avg_size"),
        mean(F.when(many, F.col("std_similarity").cast("double"))).alias("avg_std"),
    )
