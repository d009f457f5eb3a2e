"""Shared plumbing of the training-data operators: shared scratch tables and components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.shared import shared_dir

#: Rows up to which a side of fixed-width rows is broadcast (about 24 bytes each).
BROADCAST_ROWS = 500_000
#: The fewest rows that make a key hot.
HOT_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Tables of one run, written to the shared folder; this cuts lineage and survives lost executors.

    They go when the driver's process ends, or with drop(): the frame that an operator
    returns may still read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/vecspark-{uuid.uuid4().hex}"
        _made.append((spark, self.path))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        schema, path = df.schema, f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; nothing depends on it
            return


def free_name(names: list[str], wanted: str) -> str:
    """wanted, with underscores before it until no column has that name (in any case)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if its counted rows stay within the limit; else it is left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def hot_bound(spark: SparkSession, rows: int) -> int:
    """Rows beyond which a key is hot: a quarter of a mean partition. At most four times as many keys as partitions are."""
    return max(HOT_ROWS, rows // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def join_split(left: DataFrame, right: DataFrame, key: str, hot: list[int], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key; rows of the hot keys (few, by hot_bound) stay where they are."""
    if not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"{key} long"))
    return (
        left.join(keys, key, "left_anti")
        .join(right, key, how)
        .unionByName(left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how))
    )


def pairs_with(scratch: Scratch, pairs: DataFrame, table: DataFrame, hub: str, other: str, key: str, value: str, group: int = 512) -> DataFrame:
    """pairs with the value of each of its two keys, as {hub}_{value} and {other}_{value}.

    A hub's pairs are cut to groups of about `group`, each of which gets its value once, so one hub may have any number.
    """
    hubs = scratch.put(pairs.groupBy(hub).agg(F.ceil(F.count("*") / group).cast("int").alias("groups")), "hubs")
    hubs = small_side(hubs, hubs.count())
    copies = table.select(F.col(key).alias(hub), F.col(value).alias(f"{hub}_{value}")).join(hubs, hub)
    copies = copies.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    cut = pairs.join(hubs, hub).withColumn("grp", F.pmod(F.xxhash64(other), F.col("groups")).cast("int")).drop("groups")
    return cut.join(table.select(F.col(key).alias(other), F.col(value).alias(f"{other}_{value}")), other).join(copies, [hub, "grp"]).drop("grp")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the smallest node it is connected with.

    Alternating large-star and small-star rounds: each is a map-side combined minimum
    by node and a join, so a hub with any number of neighbours is never gathered.
    Each round is written to the shared folder. Self-loops are ignored.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.put(e, "edges")
    rows, before = e.count(), None
    while True:
        # no side has more rows than there are edges in both directions; few are broadcast, many are shuffled
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(small_side(low, 2 * rows), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_side(low, 2 * rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.put(low.select("a", F.col("m").alias("b")).unionAll(small).where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
