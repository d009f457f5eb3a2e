"""Incremental clustering of a stream: one micro-batch is one call of the fold.

The batch's items are ordered and folded on the driver, since each assignment depends on
all before it; the state (clusters and their members' vectors) is saved with the batch's number,
so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from vecspark.operators.cluster import Clusters


class StreamClusterer:
    """foreachBatch function over rows (item_id, embedding[, order])."""

    def __init__(self, path: str, order: str = "item_id", on_batch: Callable[[int, Clusters], None] | None = None, **options):
        self.file, self.order, self.on_batch = Path(path) / "state.pickle", order, on_batch
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.batch, self.state = -1, Clusters(**options)
        if self.file.exists():
            self.batch, self.state = pickle.loads(self.file.read_bytes())

    def __call__(self, df: DataFrame, batch: int) -> None:
        if batch <= self.batch:
            return
        rows = df.orderBy(self.order).select("item_id", "embedding").toPandas()
        if len(rows):
            self.state.add(list(zip(rows["item_id"].tolist(), map(np.asarray, rows["embedding"]), strict=True)))
        self.batch = batch
        temp = self.file.with_suffix(".tmp")
        temp.write_bytes(pickle.dumps((self.batch, self.state)))
        temp.replace(self.file)
        if self.on_batch:
            self.on_batch(batch, self.state)

    def write(self, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self)
