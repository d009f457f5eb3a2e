"""Fault-isolating batch processing and the indexing pipelines."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from vecspark.operators.aggregates import prototypes
from vecspark.operators.store import EmbeddingStore, with_dates
from vecspark.functions import vector as V

BATCH = 10
LOW_MEMORY, HIGH_MEMORY = 800 << 20, 1600 << 20


@dataclass(frozen=True)
class Success:
    total_processed: int = 0
    time_elapsed: float = 0.0


@dataclass(frozen=True)
class Failure:
    processed_before_failure: int
    time_elapsed: float
    error: Exception


@dataclass
class Listener:
    """Hooks of a run; all optional."""

    on_active: Callable[[], None] = lambda: None
    on_batch_complete: Callable[[DataFrame], None] = lambda batch: None
    on_progress: Callable[[float], None] = lambda share: None
    on_error: Callable[[Any, str], None] = lambda item, error: None
    on_complete: Callable[[Success], None] = lambda metrics: None
    on_fail: Callable[[Failure], None] = lambda metrics: None


def isolated(df: DataFrame, item: str, output: DataType, function: Callable[[Any], Any]) -> DataFrame:
    """df with columns output and error: function over the column item, one failure failing one row only."""
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("output", output), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for value in pdf[item]:
                try:
                    out.append(function(value))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - the row carries it
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            pdf = pdf[names].copy()
            pdf["output"] = pd.Series(out, index=pdf.index, dtype=object)
            pdf["error"] = pd.Series(errors, index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)


def numbered(df: DataFrame, *order: str, into: str = "row") -> DataFrame:
    """df with each row's place, from 0, in the order of columns.

    Rows are dealt by range and numbered inside their partition; only the partitions' sizes
    go through the driver, so no task holds all rows.
    """
    names = df.columns
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).persist()
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy(F.shiftright("__m", 33)).count().collect())
    at, starts = 0, []
    for part, n in sizes:
        starts += [F.lit(part), F.lit(at)]
        at += n
    start = F.create_map(*starts)[F.shiftright("__m", 33)] if starts else F.lit(0)
    return dealt.select(*names, (start.cast("long") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias(into))


def batches(df: DataFrame, *order: str, size: int = BATCH, into: str = "batch") -> DataFrame:
    """df with the number of each row's batch when rows in this order are cut into batches of a size."""
    return numbered(df, *order, into=into).withColumn(into, F.floor(F.col(into) / size).cast("long"))


@dataclass
class BatchProcessor:
    """Runs function over the rows of a frame; rows that fail are reported and left out.

    Spark's tasks are the workers, and each partition of the frame is a batch: the listener hears of each once it is
    done, in order, and of the share of batches done. run() returns the metrics and keeps the rows that succeeded in `result`.
    """

    item: str
    output: DataType
    function: Callable[[Any], Any]
    listener: Listener = field(default_factory=Listener)
    result: DataFrame | None = None

    def run(self, df: DataFrame) -> Success | Failure:
        began = time.monotonic()
        done = 0
        try:
            self.listener.on_active()
            out = isolated(df, self.item, self.output, self.function).withColumn("__batch", F.spark_partition_id()).persist()
            counts = {r[0]: r[1] for r in out.groupBy("__batch").agg(F.count_if(F.col("error").isNull())).collect()}
            for row in out.where("error IS NOT NULL").select(self.item, "error").toLocalIterator():
                self.listener.on_error(row[0], row[1])
            good = out.where("error IS NULL").drop("error")
            self.result = good.drop("__batch")
            for n, batch in enumerate(sorted(counts), 1):
                done += counts[batch]
                self.listener.on_batch_complete(good.where(F.col("__batch") == batch).drop("__batch"))
                self.listener.on_progress(n / len(counts))
            metrics = Success(done, time.monotonic() - began)
            self.listener.on_complete(metrics)
            return metrics
        except Exception as e:  # noqa: BLE001 - a failed run is a result here
            failed = Failure(done, time.monotonic() - began, e)
            self.listener.on_fail(failed)
            return failed


def concurrency(free: Column | int, low: int = LOW_MEMORY, high: int = HIGH_MEMORY, least: int = 1, most: int = 4) -> Column | int:
    """Workers for an amount of free memory: least below low, most from high on, truncated linear between."""
    if isinstance(free, int):
        if free < low:
            return least
        return most if free >= high else max(least, int(least + (free - low) / (high - low) * (most - least)))
    part = F.lit(least) + (free - F.lit(low)).cast("double") / float(high - low) * (most - least)
    return F.when(free < low, least).when(free >= high, most).otherwise(F.greatest(F.lit(least), F.floor(part).cast("int"))).cast("int")


def index_items(store: EmbeddingStore, items: DataFrame, embed: Callable[[DataFrame], DataFrame], dates: DataFrame, now_ms: int, order: str | None = None) -> int:
    """Embeds items (id, content), looks up their dates and adds them; returns how many were added.

    embed turns (id, content) into (id, embedding[, error]); rows with an error or without a
    vector are left out. Vectors are quantised if the store's are.
    """
    made = embed(items)
    made = made.where("embedding IS NOT NULL")
    if store.encoding.value == "qint8":
        made = made.withColumn("embedding", V.quantize("embedding"))
    return store.add(with_dates(made.select("id", "embedding"), dates, now_ms).select("id", "date", "embedding"), order)


def index_videos(store: EmbeddingStore, frames: DataFrame, embed: Callable[[DataFrame], DataFrame], dates: DataFrame, now_ms: int) -> int:
    """Embeds frames (id, frame, content), makes one prototype a video and adds it.

    A video one of whose frames has no content or fails is left out as a whole.
    """
    made = embed(frames)
    bad = made.where("embedding IS NULL").select("id").distinct()
    whole = made.join(bad, "id", "left_anti")
    protos = prototypes(whole, "id", "frame").select("id", "embedding")
    if store.encoding.value == "qint8":
        protos = protos.withColumn("embedding", V.quantize("embedding"))
    return store.add(with_dates(protos, dates, now_ms).select("id", "date", "embedding"), "id")
