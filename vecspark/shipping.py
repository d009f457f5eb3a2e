"""Gives executors this package, wherever the driver found it, and bounds what a Python worker is sent at once."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, so that a worker's memory does not follow the length of texts; a session's own setting stays.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the session's executors, once an application."""
    for key, value in BATCH_BYTES.items():
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="vecspark-")) / "vecspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)


def shipped(query):
    """A query (spark, ...) that ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
