"""Keyed embedding store on Parquet parts.

A store is a folder of parts and of numbered version files. A version lists parts in order: `rows` of
embeddings and `gone` ids, which take back rows of earlier parts. A change writes what it adds (an insert its rows, an
update the rows it changes, a removal ids) and then a new version file, by one rename; readers take
the newest version. So nobody sees half a change, nothing that is read is overwritten, and a crash at any point leaves
the version before. After `COMPACT` parts, and on save(), all rows are written anew as one. `_seq` keeps the insertion order.
Given rows are written once to a staging folder before they are checked, counted and inserted, so models behind them run once.

Where the original's behaviour is an accident of its cache, the store does the plain thing:
an update never inserts, an empty store is a legal state, and rows are all checked
before anything is written. Duplicate ids in one insert are all counted and the last one
stays, at the place of the first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vecspark.operators import search as S
from vecspark.schema import Encoding, InvalidEmbeddingDimension, InvalidEmbeddingType, stored_schema

#: Parts of a version beyond which a change writes all rows anew.
COMPACT = 32


def dedup_last(rows: DataFrame, order: str) -> DataFrame:
    """One row an id: the last by order, with the first's place in a column of that name."""
    w = Window.partitionBy("id")
    last = F.row_number().over(w.orderBy(F.desc(order)))
    first = F.min(order).over(w)
    return rows.select("id", "date", "embedding", F.col(order).alias("__o"), first.alias("__first"), last.alias("__last")).where("__last = 1").select("id", "date", "embedding", F.col("__first").alias(order))


def insert_absent(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new whose id the store does not have; only the store's ids are read."""
    return new.join(store.select("id"), "id", "left_anti")


def update_present(store: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """The store with date and embedding taken from the last change of each id; other changes are ignored."""
    last = dedup_last(changes, order).select("id", F.col("date").alias("__date"), F.col("embedding").alias("__embedding"), F.lit(True).alias("__hit"))
    keep = [c for c in store.columns if c not in ("id", "date", "embedding")]
    joined = store.join(last, "id", "left")
    pick = lambda new, old: F.when(F.col("__hit"), F.col(new)).otherwise(F.col(old)).alias(old)
    return joined.select("id", pick("__date", "date"), pick("__embedding", "embedding"), *keep)


def remove_ids(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def get_ids(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for wanted (pos, id) in the order asked for: missing ids are skipped, repeated ids repeat."""
    return wanted.join(store, "id").select("pos", "id", "date", "embedding")


def with_dates(rows: DataFrame, dates: DataFrame, now_ms: int) -> DataFrame:
    """rows (id, ...) with a date from dates (id, date), or now where there is none."""
    return rows.join(dates.groupBy("id").agg(F.max("date").alias("date")), "id", "left").withColumn("date", F.coalesce("date", F.lit(now_ms).cast("long")))


class EmbeddingStore:
    """Insert, update, delete, look up and search embeddings of one dimension and encoding."""

    def __init__(self, spark: SparkSession, path: str, dim: int, encoding: Encoding | str = Encoding.F32):
        self.spark, self.path, self.dim, self.encoding = spark, path.rstrip("/"), dim, Encoding(encoding)
        self.schema = StructType([*stored_schema(self.encoding).fields, StructField("_seq", LongType())])
        self._cached: DataFrame | None = None
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions
    def _versions(self) -> list[int]:
        folder = self._Path(self.path)
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    @property
    def exists(self) -> bool:
        return bool(self._versions())

    def _parts(self) -> tuple[int, list[list[str]]]:
        """The newest version's number and its parts (kind, folder); -1 and none for a new store."""
        known = self._versions()
        if not known:
            return -1, []
        stream = self._fs.open(self._Path(f"{self.path}/version-{known[-1]:012d}"))
        try:
            return known[-1], json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, before: int, parts: list[list[str]]) -> None:
        """Makes parts the version after `before`."""
        temp, target = self._Path(f"{self.path}/.next-{uuid.uuid4().hex}"), self._Path(f"{self.path}/version-{before + 1:012d}")
        out = self._fs.create(temp)
        out.write(bytearray(json.dumps(parts), "utf-8"))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(temp, target):
            self._fs.delete(temp, False)
            raise RuntimeError(f"{self.path} was changed by another writer")
        self.clear()

    def _written(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _change(self, before: int, parts: list[list[str]]) -> None:
        if len(parts) > COMPACT:
            parts = [["rows", self._written(self._folded(parts).select(*self.schema.names))]]
        self._commit(before, parts)

    def _folded(self, parts: list[list[str]]) -> DataFrame:
        """The rows of the parts, without those that a later part takes back."""
        read = self.spark.read.schema(self.schema)
        own = [(i, name) for i, (kind, name) in enumerate(parts) if kind == "rows"]
        gone = [(i, name) for i, (kind, name) in enumerate(parts) if kind == "gone"]
        if not own:
            return self.spark.createDataFrame([], self.schema)
        if not gone:
            return read.parquet(*[f"{self.path}/{name}" for _, name in own])
        rows = reduce(DataFrame.unionAll, [read.parquet(f"{self.path}/{name}").withColumn("__part", F.lit(i)) for i, name in own])
        ids = reduce(DataFrame.unionAll, [self.spark.read.schema("id long").parquet(f"{self.path}/{name}").withColumn("__gone", F.lit(i)) for i, name in gone])
        left = rows.join(ids.groupBy("id").agg(F.max("__gone").alias("__gone")), "id", "left")
        return left.where("__gone IS NULL OR __gone <= __part").select(*self.schema.names)

    def _rows(self) -> DataFrame:
        return self._cached if self._cached is not None else self._folded(self._parts()[1])

    # reading
    def get(self, ids: Sequence[int] | None = None) -> DataFrame:
        if ids is None:
            return self._rows()
        wanted = self.spark.createDataFrame(list(enumerate(map(int, ids))), "pos long, id long")
        return get_ids(self._rows(), wanted).orderBy("pos")

    def load(self) -> DataFrame:
        """Keeps the rows in memory for later calls."""
        self._cached = self._rows().cache()
        return self._cached

    def clear(self) -> None:
        """Drops what load() keeps; files stay."""
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    def query(self, embedding: Sequence[float], k: int, threshold: float = 0.0, ids=None, start: int | None = None, end: int | None = None, sims: bool = False, encoding: Encoding | str | None = None) -> DataFrame:
        rows = S.filtered(self._rows(), ids, start, end)
        if not rows.isEmpty():  # nothing to search: empty, whatever the query
            if encoding is not None and Encoding(encoding) is not self.encoding:
                raise InvalidEmbeddingType(f"the store is {self.encoding.value}")
            if len(embedding) != self.dim:
                raise InvalidEmbeddingDimension(f"query has {len(embedding)} dimensions, the store {self.dim}")
        else:
            return self.spark.createDataFrame([], "rank int, id long, sim float" if sims else "rank int, id long")
        return S.search(rows, embedding, k, threshold, sims=sims, order="_seq")

    # writing
    @contextmanager
    def _staged(self, rows: DataFrame, order: str | None) -> Iterator[DataFrame]:
        """rows (id, date, embedding, _o), written once and checked; gone at the end."""
        if Encoding.of(rows.schema["embedding"].dataType) is not self.encoding:
            raise InvalidEmbeddingType(f"the store is {self.encoding.value}")
        place = F.col(order).cast("long") if order else F.monotonically_increasing_id()
        rows = rows.select("id", "date", "embedding", place.alias("_o"))
        path = f"{self.path}/.staged-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            rows = self.spark.read.schema(rows.schema).parquet(path)
            bad = rows.agg(F.count_if(F.col("embedding").isNull() | (F.size("embedding") != self.dim))).first()[0]
            if bad:
                raise InvalidEmbeddingDimension(f"{bad} embeddings are not of dimension {self.dim}")
            yield rows
        finally:
            self._fs.delete(self._Path(path), True)

    def add(self, rows: DataFrame, order: str | None = None) -> int:
        """Appends rows (id, date, embedding) whose id is new; returns how many rows that were."""
        with self._staged(rows, order) as rows:
            before, parts = self._parts()
            store = self._folded(parts)
            last = store.agg(F.coalesce(F.max("_seq"), F.lit(-1))).first()[0]
            fresh = insert_absent(store, rows)
            count = fresh.count()
            if count:
                placed = dedup_last(fresh, "_o").withColumn("_seq", F.col("_o") + (last + 1))
                self._change(before, [*parts, ["rows", self._written(placed.select(*self.schema.names))]])
        return count

    def update(self, rows: DataFrame, order: str | None = None) -> int:
        """Overwrites rows whose id is present; returns how many of the given rows that were."""
        with self._staged(rows, order) as rows:
            before, parts = self._parts()
            store = self._folded(parts)
            known = rows.join(store.select("id", "_seq"), "id")
            count = known.count()
            if count:
                changed = dedup_last(known, "_o").drop("_o").join(store.select("id", "_seq"), "id")
                name = self._written(changed.select(*self.schema.names))
                self._change(before, [*parts, ["gone", name], ["rows", name]])
        return count

    def remove(self, ids: Sequence[int] | DataFrame) -> int:
        """Deletes; returns how many rows went."""
        own = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        before, parts = self._parts()
        if not parts:
            return 0
        name = self._written(self._folded(parts).select("id").join(own.select("id"), "id", "left_semi"))
        count = self.spark.read.schema("id long").parquet(f"{self.path}/{name}").count()
        if count:
            self._change(before, [*parts, ["gone", name]])
        else:
            self._fs.delete(self._Path(f"{self.path}/{name}"), True)
        return count

    def save(self) -> None:
        """Compacts the store into one fresh part and deletes older parts and versions."""
        before, parts = self._parts()
        if before < 0:
            return
        name = self._written(self._folded(parts).select(*self.schema.names))
        self._commit(before, [["rows", name]])
        for f in self._fs.listStatus(self._Path(self.path)):
            if f.getPath().getName() not in (name, f"version-{before + 1:012d}"):
                self._fs.delete(f.getPath(), True)
