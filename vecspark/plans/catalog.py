"""Every query of the engine's own operators, with the SQL that gives the same rows.

The store is the table embeddings: id = vec_id, date = (vec_id + 1) * 100, and its label as the
class. Other inputs (boxes, sizes, step scores) are derived from whole tables by formulas.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from vecspark.functions import geometry as G
from vecspark.functions import image as I
from vecspark.functions import text as T
from vecspark.functions import vector as V
from vecspark.operators import aggregates as A
from vecspark.operators import batch as B
from vecspark.operators import classify as C
from vecspark.operators import cluster as K
from vecspark.operators import providers as P
from vecspark.operators import search as S
from vecspark.operators import store as ST
from vecspark.operators.ann import IvfIndex, recall
from vecspark.shared import shared_dir
from vecspark.sources.embstore import EmbeddingFileSource
from vecspark.sources.media import frame_times

_queries: dict = {}
_oracles: dict = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_queries)


def oracle_sql():
    return dict(_oracles)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("vec_id") + 1) * 100).alias("date"), "embedding")


def _vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return _table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


# SQL pieces
def _sim(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] * x[2])::DOUBLE))::FLOAT"


def _norm(v: str) -> str:
    return f"sqrt(list_reduce(list_prepend(0::FLOAT, list_transform({v}, lambda x: (x * x)::FLOAT)), lambda t, x: (t + x)::FLOAT)::DOUBLE)::FLOAT"


_STORE = "(SELECT vec_id AS id, (vec_id + 1) * 100 AS date, embedding FROM embeddings)"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_QUANT = "list_transform({0}, lambda x: (((floor((x * 127::FLOAT)::DOUBLE + 0.5)::BIGINT + 128) % 256 + 256) % 256 - 128)::TINYINT)"
_FOLD = "list_reduce(list({0} ORDER BY {1}), lambda a, b: list_transform(list_zip(a, b), lambda x: (x[1] + x[2])::FLOAT))"


def _top(where: str, k: int, threshold: float, sims: bool = True, sim: str | None = None) -> str:
    sim = sim or _sim("embedding", _Q)
    return f"""
    WITH s AS (SELECT id, {sim} AS sim FROM {_STORE} WHERE {where}),
    r AS (SELECT (row_number() OVER (ORDER BY sim DESC, id) - 1)::INTEGER AS rank, id, sim FROM s WHERE sim >= {threshold}::FLOAT)
    SELECT rank, id{", sim" if sims else ""} FROM r WHERE rank < {k}"""


# similarity search
@query(_top("true", 5, 0.2))
def search_topk(spark, sf):
    return S.search(_store(spark, sf), _vector(spark, sf), 5, 0.2, sims=True, dim=64)


@query(_top("true", 1000000, 0.1))
def search_threshold(spark, sf):
    return S.search(_store(spark, sf), _vector(spark, sf), 1_000_000, 0.1, sims=True)


@query(_top("id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)", 5, -1))
def search_ids(spark, sf):
    return S.search(_store(spark, sf), _vector(spark, sf), 5, -1, ids=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], sims=True)


@query(_top("id IN (SELECT vec_id FROM embeddings WHERE label = 3)", 5, -1))
def search_id_table(spark, sf):
    ids = _table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return S.search(_store(spark, sf), _vector(spark, sf), 5, -1, ids=ids, sims=True)


@query(_top("date BETWEEN 5000 AND 20000", 5, -1))
def search_dates(spark, sf):
    return S.search(_store(spark, sf), _vector(spark, sf), 5, -1, start=5000, end=20000, sims=True)


@query(_top("true", 5, 0.2, sims=False))
def search_no_sims(spark, sf):
    return S.search(_store(spark, sf), _vector(spark, sf), 5, 0.2)


@query(
    f"""
    WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 25 = 0),
    s AS (SELECT qid, vec_id AS id, {_sim("embedding", "q")} AS sim FROM embeddings, q),
    r AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1)::INTEGER AS rank, id, sim FROM s WHERE sim >= 0)
    SELECT * FROM r WHERE rank < 3"""
)
def search_batch(spark, sf):
    q = _table(spark, sf, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return S.batch_search(spark, _store(spark, sf), q, 3)


_QSIM = "(list_sum(list_transform(list_zip({0}, {1}), lambda x: (x[1]::INTEGER * x[2]::INTEGER)::DOUBLE))::FLOAT / 16129::FLOAT)::FLOAT"


@query(_top("true", 10, 0.1, sim=_QSIM.format(_QUANT.format("embedding"), f"(SELECT {_QUANT.format('embedding')} FROM embeddings WHERE vec_id = 0)")))
def qint8_search(spark, sf):
    from vecspark.kernels import quantize

    q = quantize(np.float32(_vector(spark, sf))).tolist()
    return S.search(_store(spark, sf).withColumn("embedding", V.quantize("embedding")), q, 10, 0.1, sims=True)


# vector functions
def _exploded(df: DataFrame, column) -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("pos", "val"))


def _unnested(v: str, kind: str) -> str:
    return f"SELECT vec_id, (unnest(range(len(v))))::INTEGER AS pos, unnest(v)::{kind} AS val FROM (SELECT vec_id, {v} AS v FROM embeddings)"


@query(_unnested(_QUANT.format("embedding"), "TINYINT"))
def quantize(spark, sf):
    return _exploded(_table(spark, sf, "embeddings"), V.quantize("embedding"))


_DEQUANT = "list_transform({0}, lambda b: (b::FLOAT / 127::FLOAT)::FLOAT)"


@query(_unnested(_DEQUANT.format(_QUANT.format("embedding")), "FLOAT"))
def dequantize(spark, sf):
    return _exploded(_table(spark, sf, "embeddings"), V.dequantize(V.quantize("embedding")))


@query(f"SELECT vec_id, list_max(list_transform(list_zip(embedding, {_DEQUANT.format(_QUANT.format('embedding'))}), lambda x: abs(x[1] - x[2])))::FLOAT AS worst FROM embeddings")
def quant_error(spark, sf):
    gap = F.zip_with("embedding", V.dequantize(V.quantize("embedding")), lambda x, y: F.abs(x - y))
    return _table(spark, sf, "embeddings").select("vec_id", F.array_max(gap).alias("worst"))


_SCALED = "list_transform(embedding, lambda x: (x * (vec_id % 7 + 2)::FLOAT)::FLOAT)"


@query(
    f"""SELECT vec_id, (unnest(range(len(v))))::INTEGER AS pos, unnest(list_transform(v, lambda x: (x / n)::FLOAT)) AS val
    FROM (SELECT vec_id, v, {_norm("v")} AS n FROM (SELECT vec_id, {_SCALED} AS v FROM embeddings))"""
)
def normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: (x * (F.col("vec_id") % 7 + 2).cast("float")).cast("float"))
    return _exploded(_table(spark, sf, "embeddings"), V.normalize(scaled))


@query(
    f"""SELECT vec_id, (unnest(range(len(v))))::INTEGER AS pos, unnest({_QUANT.format("list_transform(v, lambda y: (y / n)::FLOAT)")}) AS val
    FROM (SELECT vec_id, v, {_norm("v")} AS n FROM (SELECT vec_id, {_DEQUANT.format(_QUANT.format("embedding"))} AS v FROM embeddings))"""
)
def normalize_q(spark, sf):
    return _exploded(_table(spark, sf, "embeddings"), V.normalize_q(V.quantize("embedding")))


@query(f"SELECT a.vec_id, {_sim('a.embedding', 'b.embedding')} AS sim, (1::FLOAT - {_sim('a.embedding', 'b.embedding')})::FLOAT AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_pairs(spark, sf):
    e = _table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", V.dot("embedding", "other").alias("sim"), V.distance("embedding", "other").alias("distance"))


@query(f"SELECT vec_id, {_sim('embedding', 'embedding')} AS sim, list_sum({_QUANT.format('embedding')})::BIGINT AS total FROM embeddings")
def sql_functions(spark, sf):
    V.register_sql(spark)
    return _table(spark, sf, "embeddings").selectExpr("vec_id", "vec_dot(embedding, embedding) AS sim", "aggregate(vec_quantize(embedding), 0L, (t, x) -> t + x) AS total")


@query("SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INTEGER AS part, len(embedding)::INTEGER AS size, embedding[1] AS head, embedding[64] AS tail FROM embeddings")
def flatten_roundtrip(spark, sf):
    e = _table(spark, sf, "embeddings")
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    flat = e.groupBy("label").agg(rows.alias("r")).select("label", F.transform("r", lambda x: x["vec_id"]).alias("ids"), V.flatten_vectors(F.transform("r", lambda x: x["embedding"]), 64).alias("flat"))
    back = flat.select("label", "ids", F.posexplode(V.unflatten_vector("flat", 64)).alias("part", "v"))
    return back.select("label", F.get("ids", F.col("part")).alias("vec_id"), "part", V.vector_size("v").alias("size"), F.element_at("v", 1).alias("head"), F.element_at("v", 64).alias("tail"))


# aggregates
@query(f"SELECT label, n::INTEGER AS n, (unnest(range(64)))::INTEGER AS pos, unnest(t) AS val FROM (SELECT label, count(*) AS n, {_FOLD.format('embedding', 'vec_id')} AS t FROM embeddings GROUP BY label)")
def sum_by_label(spark, sf):
    return A.sum_vectors(_table(spark, sf, "embeddings"), "label", "vec_id").select("label", "n", F.posexplode("total").alias("pos", "val"))


_SUMS = "SELECT label, count(*) AS n, {0} AS t FROM embeddings{1} GROUP BY label"
_PROTO = f"""(SELECT label, n, list_transform(m, lambda x: (x / l)::FLOAT) AS p FROM (SELECT label, n, m, {_norm("m")} AS l FROM
  (SELECT label, n, list_transform(t, lambda x: (x / n::FLOAT)::FLOAT) AS m FROM ({_SUMS.format(_FOLD.format("embedding", "vec_id"), "{0}")}))))"""


@query(f"SELECT label, n::INTEGER AS n, (unnest(range(64)))::INTEGER AS pos, unnest(p) AS val FROM {_PROTO.format('')}")
def proto_by_label(spark, sf):
    return A.prototypes(_table(spark, sf, "embeddings"), "label", "vec_id").select("label", "n", F.posexplode("embedding").alias("pos", "val"))


@query(f"SELECT label, n::INTEGER AS n, round(list_sum(list_transform(t, lambda x: abs(x::DOUBLE))), 3) AS total FROM ({_SUMS.format(_FOLD.format('embedding', 'vec_id'), '')})")
def sum_by_label_wide(spark, sf):
    wide = A.sum_vectors_wide(_table(spark, sf, "embeddings"), "label", 64)
    return wide.select("label", "n", F.round(F.aggregate("total", F.lit(0.0), lambda t, x: t + F.abs(x.cast("double"))), 3).alias("total"))


_QFOLD = _FOLD.format(_DEQUANT.format(_QUANT.format("embedding")), "vec_id")


@query(
    f"""SELECT label, n::INTEGER AS n, (unnest(range(64)))::INTEGER AS pos, unnest({_QUANT.format("list_transform(m, lambda y: (y / l)::FLOAT)")}) AS val
    FROM (SELECT label, n, m, {_norm("m")} AS l FROM (SELECT label, n, list_transform(t, lambda x: (x / n::FLOAT)::FLOAT) AS m FROM ({_SUMS.format(_QFOLD, "")})))"""
)
def proto_q_by_label(spark, sf):
    q = _table(spark, sf, "embeddings").withColumn("embedding", V.quantize("embedding"))
    return A.prototypes_q(q, "label", "vec_id").select("label", "n", F.posexplode("embedding").alias("pos", "val"))


@query(
    f"""WITH a AS (SELECT * FROM {_PROTO.format(" WHERE vec_id % 2 = 0")}), b AS ({_SUMS.format(_FOLD.format("embedding", "vec_id"), " WHERE vec_id % 2 = 1")}),
    u AS (SELECT a.label, a.n + b.n AS k, list_transform(list_zip(p, t), lambda x: (((a.n::FLOAT * x[1])::FLOAT + x[2])::FLOAT / (a.n + b.n)::FLOAT)::FLOAT) AS m FROM a JOIN b USING (label))
    SELECT label, k::INTEGER AS n, (unnest(range(64)))::INTEGER AS pos, unnest(list_transform(m, lambda x: (x / l)::FLOAT)) AS val FROM (SELECT label, k, m, {_norm("m")} AS l FROM u)"""
)
def update_proto(spark, sf):
    e = _table(spark, sf, "embeddings")
    old = A.prototypes(e.where("vec_id % 2 = 0"), "label", "vec_id")
    return A.update_prototypes(old, e.where("vec_id % 2 = 1"), "label", "vec_id").select("label", "n", F.posexplode("embedding").alias("pos", "val"))


# classification and clusters
_CLASSES = f"""
p AS (SELECT * FROM {_PROTO.format("")}),
m AS (SELECT label, n, list({_sim("e.embedding", "p.p")}::DOUBLE ORDER BY vec_id) AS s FROM embeddings e JOIN p USING (label) GROUP BY label, n),
a AS (SELECT label, n, s, list_reduce(list_prepend(0::DOUBLE, s), lambda t, x: t + x) / n AS mean FROM m),
c AS (SELECT label, mean::FLOAT AS mean, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(s, lambda x: (x - mean) * (x - mean))), lambda t, x: t + x) / n)::FLOAT AS std, n FROM a)
"""


def _classes(spark, sf):
    return C.class_prototypes(_table(spark, sf, "embeddings"), "label", "vec_id")


@query(f"WITH {_CLASSES} SELECT label::BIGINT AS cluster_id, n::INTEGER AS prototype_size, mean AS mean_similarity, std AS std_similarity FROM c")
def class_stats(spark, sf):
    return _classes(spark, sf).select("cluster_id", "prototype_size", "mean_similarity", "std_similarity")


@query(
    f"""WITH {_CLASSES},
    t AS (SELECT e.vec_id, p.label AS class_id, {_sim("e.embedding", "p.p")} AS sim FROM embeddings e, p),
    g AS (SELECT t.* FROM t JOIN c ON c.label = t.class_id WHERE sim >= (mean - std)::FLOAT AND sim > -1),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class_id) AS k FROM g)
    SELECT e.vec_id AS item_id, r.class_id::BIGINT AS class_id, coalesce(r.sim, -1)::FLOAT AS similarity FROM embeddings e LEFT JOIN r ON r.vec_id = e.vec_id AND k = 1"""
)
def few_shot(spark, sf):
    return C.few_shot(spark, _table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), _classes(spark, sf))


@query(
    f"""WITH p AS (SELECT label::BIGINT AS id, p FROM {_PROTO.format("")}),
    s AS (SELECT a.id AS cluster_id, b.id AS target, CASE WHEN a.id = b.id THEN 0::FLOAT ELSE {_sim("a.p", "b.p")} END AS sim FROM p a, p b)
    SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC, target) - 1)::INTEGER AS rank FROM s WHERE sim >= 0.1::FLOAT"""
)
def cluster_merges(spark, sf):
    return K.merge_proposals(spark, _classes(spark, sf), 0.1)


@query(f"WITH {_CLASSES} SELECT round(avg(mean::DOUBLE) FILTER (n > 1), 6) AS avg_cohesion, round(avg(n), 6) AS avg_size, round(avg(std::DOUBLE) FILTER (n > 1), 6) AS avg_std FROM c")
def cluster_stats(spark, sf):
    s = A.cluster_averages(_classes(spark, sf))
    return s.select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in s.columns])


@query(
    f"""WITH {_CLASSES}, v AS (SELECT avg(mean::DOUBLE) AS coh FROM c WHERE n > 1),
    b AS (SELECT label, n, mean::DOUBLE AS mean, std::DOUBLE AS std, 0.3 * (1 - exp(-n::DOUBLE)) AS base, coh FROM c, v),
    x AS (SELECT *, 1 / (1 + exp(-((mean - coh) / greatest(1e-6, coh)))) AS alpha FROM b)
    SELECT label::BIGINT AS cluster_id, round(CASE WHEN n < 5 OR coh <= 0 THEN base ELSE alpha * greatest(mean - std, base) + (1 - alpha) * base END, 6) AS threshold FROM x"""
)
def adaptive_threshold(spark, sf):
    c = _classes(spark, sf)
    coh = c.where("prototype_size > 1").agg(F.avg(F.col("mean_similarity").cast("double")).alias("coh"))
    t = K.threshold_column(F.col("prototype_size"), F.col("mean_similarity"), F.col("std_similarity"), F.col("coh"), 5)
    return c.crossJoin(F.broadcast(coh)).select("cluster_id", F.round(t, 6).alias("threshold"))  # coh is one row


@query(f"WITH {_CLASSES} SELECT round(greatest(0.3, avg(mean::DOUBLE) - avg(std::DOUBLE)), 6) AS merge_threshold FROM c WHERE n > 1")
def merge_threshold(spark, sf):
    s = A.cluster_averages(_classes(spark, sf))
    return s.select(F.round(F.greatest(F.lit(0.3), F.col("avg_cohesion").cast("double") - F.col("avg_std").cast("double")), 6).alias("merge_threshold"))


@query()
def incremental_cluster(spark, sf):
    items = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return K.assign_incrementally(items).select("item_id", "cluster_id")


@query()
def incremental_clusters(spark, sf):
    items = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return K.clusters_of(items, group="label").select("grp", "cluster_id", "prototype_size", "mean_similarity", "std_similarity")


# store
_HALF = "(SELECT vec_id AS id, (vec_id + 1) * 100 AS date FROM embeddings WHERE vec_id % 2 = 0)"


@query("SELECT vec_id AS id, (vec_id + 1) * 100 AS date FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 = 0")
def store_add(spark, sf):
    s = _store(spark, sf)
    return ST.insert_absent(s.where("id % 2 = 0"), s.where("id % 3 = 0")).select("id", "date")


@query(f"SELECT id, CASE WHEN id % 5 = 0 THEN 999 ELSE date END AS date FROM {_HALF}")
def store_update(spark, sf):
    s = _store(spark, sf)
    changes = s.where("id % 5 = 0").select("id", F.lit(1).cast("long").alias("date"), "embedding", F.lit(0).alias("o"))
    changes = changes.unionAll(s.where("id % 5 = 0").select("id", F.lit(999).cast("long"), "embedding", F.lit(1)))
    return ST.update_present(s.where("id % 2 = 0"), changes, "o").select("id", "date")


@query(f"SELECT id, date FROM {_HALF} WHERE id % 7 <> 0")
def store_remove(spark, sf):
    s = _store(spark, sf)
    return ST.remove_ids(s.where("id % 2 = 0"), s.where("id % 7 = 0").select("id")).select("id", "date")


@query("SELECT p.pos, v.vec_id AS id, (v.vec_id + 1) * 100 AS date FROM (VALUES (0::BIGINT, 7), (1, 3), (2, 7), (3, 99999999), (4, 0)) p(pos, id) JOIN embeddings v ON v.vec_id = p.id")
def store_get_ids(spark, sf):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 99999999), (4, 0)], "pos long, id long")
    return ST.get_ids(_store(spark, sf), wanted).select("pos", "id", "date")


@query("SELECT vec_id % 100 AS id, max((vec_id + 1) * 100) AS date, min(vec_id) AS place FROM embeddings GROUP BY 1")
def store_dedup_last(spark, sf):
    rows = _store(spark, sf).select((F.col("id") % 100).alias("id"), "date", "embedding", F.col("id").alias("place"))
    return ST.dedup_last(rows, "place").select("id", "date", "place")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN vec_id * 10 ELSE 1700000000000 END AS date FROM embeddings")
def date_lookup(spark, sf):
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return ST.with_dates(e, e.where("id % 3 = 0").select("id", (F.col("id") * 10).alias("date")), 1_700_000_000_000)


@query("SELECT vec_id AS id, (vec_id + 1) * 100 AS date FROM embeddings WHERE label <> 9")
def store_lifecycle(spark, sf):
    """The whole table goes in, in two overlapping parts by label; the ids of one label go again."""
    import uuid

    s = _store(spark, sf).join(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    store = ST.EmbeddingStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 64)
    store.add(s.where("label < 6"), "id")
    store.add(s.where("label >= 4"), "id")
    store.remove(s.where("label = 9").select("id"))
    return store.get().select("id", "date")


@query(f"SELECT vec_id AS id, (vec_id + 1) * 100 AS date, list_sum({_QUANT.format('embedding')})::BIGINT AS total FROM embeddings")
def embstore_roundtrip(spark, sf):
    """Writes and reads the binary format; its files are local to the driver's machine."""
    spark.dataSource.register(EmbeddingFileSource)
    folder = tempfile.mkdtemp(prefix="vecspark-bin-")
    own = _store(spark, sf).withColumn("embedding", V.quantize("embedding"))
    own.write.format("embstore").options(dim="64", encoding="qint8").mode("overwrite").save(folder)
    got = spark.read.format("embstore").options(dim="64", encoding="qint8").load(folder)
    return got.select("id", "date", F.aggregate("embedding", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


# approximate search
def _ann(spark, sf):
    s = _store(spark, sf)
    q = s.where("id % 25 = 0").select(F.col("id").alias("qid"), "embedding")
    index = IvfIndex.build(spark, s.select("id", "embedding"))
    return s, q, index


@query()
def ann_topk(spark, sf):
    _, q, index = _ann(spark, sf)
    return index.query(q, 10, max(1, len(index.centroids) // 2))


@query()
def ann_recall(spark, sf):
    s, q, index = _ann(spark, sf)
    exact = S.batch_search(spark, s, q, 10, threshold=-1.0)
    return recall(exact, index.query(q, 10, max(1, len(index.centroids) * 3 // 4)))


@query(
    f"""WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT qid, vec_id AS id, {_sim("embedding", "q")} AS sim FROM embeddings, q),
    r AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1)::INTEGER AS rank, id, sim FROM s) SELECT * FROM r WHERE rank < 5"""
)
def ann_all_lists(spark, sf):
    s = _store(spark, sf)
    index = IvfIndex.build(spark, s.select("id", "embedding"))
    return index.query(s.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding"), 5, len(index.centroids))


# text
@query("SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')) AS clean FROM documents")
def clip_clean(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.clip_clean("text").alias("clean"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '([.,!?;:()"''])', ' \\1 ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents""")
def minilm_preprocess(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", T.minilm_clean("text").alias("clean"))


@query(
    r"""SELECT doc_id, len(p)::INTEGER AS pieces, array_to_string(p, ' ') AS joined
    FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), '<\|startoftext\|>|<\|endoftext\|>|''s|''t|''re|''ve|''m|''ll|''d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+') AS p FROM documents)"""
)
def clip_pretokenize(spark, sf):
    p = T.clip_pieces(T.clip_clean("text"))
    return _table(spark, sf, "documents").select("doc_id", F.size(p).alias("pieces"), F.array_join(p, " ").alias("joined"))


def _clip(spark, sf):
    import public_tokenizers

    docs = _table(spark, sf, "documents").select("doc_id", T.clip_clean("text").alias("clean"))
    return T.tokenized(docs, T.ClipBpe(*T.clip_from_json(public_tokenizers.path("word_bpe_49k.json"))), "clean")


@query()
def bpe(spark, sf):
    return _clip(spark, sf).select("doc_id", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query(
    """WITH w AS (SELECT doc_id, ([49406] || list_transform(string_split(lower(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')), ' '), lambda x: length(x)::INTEGER) || [49407])[:77] AS ids FROM documents),
    f AS (SELECT doc_id, list_resize(ids, 77, 0) AS ids FROM w)
    SELECT doc_id, len(ids)::INTEGER AS n, ids[1] AS head, ids[77] AS tail, list_sum(ids)::BIGINT AS total FROM f"""
)
def clip_frame(spark, sf):
    """Frames of the numbers of letters of each text's words, in place of tokens."""
    words = F.transform(F.split(T.clip_clean("text"), " "), lambda x: F.length(x))
    f = T.clip_frame("ids")
    docs = _table(spark, sf, "documents").select("doc_id", words.alias("ids"))
    total = F.aggregate(f, F.lit(0).cast("long"), lambda t, x: t + x)
    return docs.select("doc_id", F.size(f).alias("n"), F.element_at(f, 1).alias("head"), F.element_at(f, 77).alias("tail"), total.alias("total"))


_VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *".,!?;:()\"'", "the", "and", "of", "to", "tion", "er", "##er", "##tion", "##in", "##th", "##ent", *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"]]


@query()
def wordpiece(spark, sf):
    vocab = {w: i for i, w in enumerate(_VOCAB)}
    docs = T.tokenized(_table(spark, sf, "documents").select("doc_id", T.minilm_clean("text").alias("clean")), T.WordPiece(vocab), "clean")
    ids, mask = T.minilm_frame("ids", vocab["[CLS]"], vocab["[SEP]"])
    total = lambda c: F.aggregate(c, F.lit(0), lambda t, x: t + x)
    return docs.select("doc_id", F.size("ids").alias("n"), F.size(ids).alias("framed"), total(mask).alias("used"), F.aggregate("ids", F.lit(0).cast("long"), lambda t, x: t + x).alias("total"))


@query(
    """WITH s AS (SELECT user_id AS b, event_id AS t, c, (((event_id * 7 + c * 13 + user_id) % 101)::DOUBLE / 101)::FLOAT AS p FROM events, range(5) r(c)),
    m AS (SELECT b, t, c, p FROM (SELECT *, row_number() OVER (PARTITION BY b, t ORDER BY p DESC, c) AS k FROM s) WHERE k = 1),
    l AS (SELECT *, lag(c) OVER (PARTITION BY b ORDER BY t) AS before FROM m),
    u AS (SELECT b, t, ['a', 'b', 'c'][c] AS letter, p, c BETWEEN 1 AND 3 AND c IS DISTINCT FROM before AS use FROM l),
    g AS (SELECT b, coalesce(string_agg(letter, '' ORDER BY t) FILTER (use), '') AS text, list(p::DOUBLE ORDER BY t) FILTER (use) AS ps FROM u GROUP BY b)
    SELECT b, text, coalesce(list_reduce(list_prepend(0::DOUBLE, ps), lambda t, x: t + x) / len(ps), 0)::FLOAT AS confidence FROM g"""
)
def ctc_decode(spark, sf):
    e = _table(spark, sf, "events").select(F.col("user_id").alias("b"), F.col("event_id").alias("t"), F.explode(F.array(*[F.lit(c) for c in range(5)])).alias("c"))
    p = (((F.col("t") * 7 + F.col("c") * 13 + F.col("b")) % 101).cast("double") / 101).cast("float")
    return T.ctc_decode(e.withColumn("p", p), ["a", "b", "c"])


# boxes and sizes
_BOX = "p_partkey AS id, (p_partkey % 97)::FLOAT AS x1, (p_partkey * 3 % 89)::FLOAT AS y1, (p_partkey % 97 + p_size)::FLOAT AS x2, (p_partkey * 3 % 89 + p_size % 13 + 1)::FLOAT AS y2"


def _boxes(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    f = lambda c: c.cast("float")
    return _table(spark, sf, "part").select(k.alias("id"), F.struct(f(k % 97).alias("x1"), f(k * 3 % 89).alias("y1"), f(k % 97 + s).alias("x2"), f(k * 3 % 89 + s % 13 + 1).alias("y2")).alias("box"))


@query(
    f"""WITH b AS (SELECT {_BOX} FROM part),
    i AS (SELECT a.id, (greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)))::FLOAT AS inter,
      ((a.x2 - a.x1) * (a.y2 - a.y1))::FLOAT AS s, ((c.x2 - c.x1) * (c.y2 - c.y1))::FLOAT AS t FROM b a JOIN b c ON c.id = a.id + 97)
    SELECT id, CASE WHEN s + t - inter <= 0 THEN 0::FLOAT ELSE (inter / (s + t - inter))::FLOAT END AS iou FROM i"""
)
def iou_pairs(spark, sf):
    b = _boxes(spark, sf)
    c = b.select((F.col("id") - 97).alias("id"), F.col("box").alias("other"))
    return b.join(c, "id").select("id", G.iou(F.col("box"), F.col("other")).alias("iou"))


_SIZES = "(SELECT o_orderkey AS id, (o_orderkey % 4000 + 1)::INTEGER AS w, (o_custkey % 3000 + 1)::INTEGER AS h FROM orders)"


def _sizes(spark, sf):
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4000 + 1).cast("int").alias("w"), (F.col("o_custkey") % 3000 + 1).cast("int").alias("h"))


@query(
    f"""SELECT id, CASE WHEN w <= 1024 AND h <= 1024 THEN w WHEN w >= h THEN 1024 ELSE trunc(w::FLOAT * (1024::FLOAT / h::FLOAT)::FLOAT)::INTEGER END AS w,
    CASE WHEN w <= 1024 AND h <= 1024 THEN h WHEN w >= h THEN trunc(h::FLOAT * (1024::FLOAT / w::FLOAT)::FLOAT)::INTEGER ELSE 1024 END AS h FROM {_SIZES}"""
)
def scaled_dims(spark, sf):
    s = _sizes(spark, sf).select("id", G.scaled_dimensions(F.col("w"), F.col("h")).alias("d"))
    return s.select("id", "d.w", "d.h")


def _resize_sql(ratio: str, most: int) -> str:
    return f"""WITH r AS (SELECT id, w, h, {ratio} AS r FROM {_SIZES}), n AS (SELECT id, trunc(w * r) AS w, trunc(h * r) AS h FROM r),
    c AS (SELECT id, CASE WHEN greatest(w, h) > {most} THEN trunc(w * ({most}::DOUBLE / greatest(w, h))) ELSE w END AS w, CASE WHEN greatest(w, h) > {most} THEN trunc(h * ({most}::DOUBLE / greatest(w, h))) ELSE h END AS h FROM n)
    SELECT id, greatest(round_even(w / 32.0::DOUBLE, 0)::INTEGER * 32, 32) AS w, greatest(round_even(h / 32.0::DOUBLE, 0)::INTEGER * 32, 32) AS h FROM c"""


def _resized(spark, sf, limit, kind, most):
    return _sizes(spark, sf).select("id", G.multiple_of_32(F.col("w"), F.col("h"), limit, kind, most).alias("d")).select("id", "d.w", "d.h")


@query(_resize_sql("CASE WHEN greatest(w, h) > 960 THEN 960::DOUBLE / greatest(w, h) ELSE 1::DOUBLE END", 4000))
def resize32_max(spark, sf):
    return _resized(spark, sf, 960, "max", 4000)


@query(_resize_sql("CASE WHEN least(w, h) < 736 THEN 736::DOUBLE / least(w, h) ELSE 1::DOUBLE END", 4000))
def resize32_min(spark, sf):
    return _resized(spark, sf, 736, "min", 4000)


@query(_resize_sql("960::DOUBLE / greatest(w, h)", 900))
def resize32_long(spark, sf):
    return _resized(spark, sf, 960, "resize_long", 900)


@query(f"SELECT id, x1::INTEGER AS x, y1::INTEGER AS y, (least(80, x2::INTEGER) - x1::INTEGER)::INTEGER AS w, (least(80, y2::INTEGER) - y1::INTEGER)::INTEGER AS h FROM (SELECT {_BOX} FROM part) WHERE least(80, x2) > x1 AND least(80, y2) > y1")
def crop_boxes(spark, sf):
    c = _boxes(spark, sf).select("id", G.crop_box(F.col("box"), F.lit(80), F.lit(80)).alias("c")).where("c IS NOT NULL")
    return c.select("id", "c.x", "c.y", "c.w", "c.h")


@query("SELECT p_partkey AS id, round(w + 2 * (w * h * 1.5 / (2 * (w + h))), 6) AS w, round(h + 2 * (w * h * 1.5 / (2 * (w + h))), 6) AS h FROM (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 31 + 1)::DOUBLE AS h FROM part)")
def expand_rect(spark, sf):
    p = _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("w"), (F.col("p_partkey") % 31 + 1).cast("double").alias("h"))
    e = p.select("id", G.expanded(F.col("w"), F.col("h"), 1.5).alias("e"))
    return e.select("id", F.round("e.w", 6).alias("w"), F.round("e.h", 6).alias("h"))


_POINTS = "(SELECT p_partkey % 20 AS component, p_size::DOUBLE AS x, (p_partkey % 53)::DOUBLE AS y FROM part)"


@query(
    f"""WITH p AS (SELECT * FROM {_POINTS}), m AS (SELECT component, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1), d AS (SELECT p.component, n, cx, cy, x - cx AS dx, y - cy AS dy FROM p JOIN m USING (component)),
    a AS (SELECT component, 0.5 * atan2(2 * sum(dx * dy), sum(dx * dx) - sum(dy * dy)) AS angle FROM d GROUP BY 1),
    t AS (SELECT d.component, n, cx, cy, angle, dx * cos(angle) + dy * sin(angle) AS u, -dx * sin(angle) + dy * cos(angle) AS v FROM d JOIN a USING (component))
    SELECT component, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(max(u) - min(u), 4) AS w, round(max(v) - min(v), 4) AS h, round(angle, 4) AS angle FROM t GROUP BY component, n, cx, cy, angle"""
)
def rotated_rects(spark, sf):
    p = _table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("component"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 53).cast("double").alias("y"))
    r = G.rotated_rects(p)
    return r.select("component", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "h", "angle")])


_QUAD = "[{'x': (p_partkey * 7 % 101)::FLOAT, 'y': (p_partkey * 11 % 103)::FLOAT}, {'x': (p_size * 3 % 107)::FLOAT, 'y': (p_partkey * 5 % 97)::FLOAT}, {'x': (p_partkey * 13 % 109)::FLOAT, 'y': p_size::FLOAT}, {'x': (p_partkey * 17 % 113)::FLOAT, 'y': (p_size * 7 % 89)::FLOAT}]"


@query(
    f"""WITH q AS (SELECT p_partkey AS id, unnest(range(4)) AS i, unnest({_QUAD}) AS p FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p.x + p.y, i) AS a, row_number() OVER (PARTITION BY id ORDER BY p.x - p.y, i) AS b,
      row_number() OVER (PARTITION BY id ORDER BY p.x + p.y DESC, i) AS c, row_number() OVER (PARTITION BY id ORDER BY p.x - p.y DESC, i) AS d FROM q)
    SELECT id, max(p.x) FILTER (a = 1) AS x0, max(p.x) FILTER (b = 1) AS x1, max(p.x) FILTER (c = 1) AS x2, max(p.x) FILTER (d = 1) AS x3 FROM r GROUP BY id"""
)
def corner_order(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))
    quad = F.array(point(k * 7 % 101, k * 11 % 103), point(s * 3 % 107, k * 5 % 97), point(k * 13 % 109, s), point(k * 17 % 113, s * 7 % 89))
    o = _table(spark, sf, "part").select(k.alias("id"), G.corner_order(quad).alias("o"))
    return o.select("id", *[F.get("o", F.lit(i))["x"].alias(f"x{i}") for i in range(4)])


@query(
    f"""WITH q AS (SELECT p_partkey AS id, unnest(range(4)) AS i, unnest({_QUAD}) AS p FROM part),
    r AS (SELECT id, p, row_number() OVER (PARTITION BY id ORDER BY p.x, i) AS n FROM q),
    f AS (SELECT id, max(p) FILTER (n = 1) AS a, max(p) FILTER (n = 2) AS b, max(p) FILTER (n = 3) AS c, max(p) FILTER (n = 4) AS d FROM r GROUP BY id),
    o AS (SELECT id, CASE WHEN b.y > a.y THEN a ELSE b END AS p0, CASE WHEN d.y > c.y THEN c ELSE d END AS p1, CASE WHEN d.y > c.y THEN d ELSE c END AS p2, CASE WHEN b.y > a.y THEN b ELSE a END AS p3 FROM f)
    SELECT id, p0.x AS x0, p0.y AS y0, p1.x AS x1, p1.y AS y1, p2.x AS x2, p2.y AS y2, p3.x AS x3, p3.y AS y3 FROM o"""
)
def quad_order(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    point = lambda x, y: F.struct(x.cast("float").alias("x"), y.cast("float").alias("y"))
    quad = F.array(point(k * 7 % 101, k * 11 % 103), point(s * 3 % 107, k * 5 % 97), point(k * 13 % 109, s), point(k * 17 % 113, s * 7 % 89))
    o = _table(spark, sf, "part").select(k.alias("id"), G.quad_order(quad).alias("o"))
    return o.select("id", *[F.get("o", F.lit(i))[c].alias(f"{c}{i}") for i in range(4) for c in "xy"])


def _scored_boxes(spark, sf):
    score = ((F.col("id") * 37 % 1009).cast("double") / 1009).cast("float")
    return _boxes(spark, sf).select((F.col("id") % 20).alias("image_id"), F.col("id").alias("box_id"), "box.*", score.alias("score"))


@query(
    f"""WITH RECURSIVE b AS (SELECT id % 20 AS image_id, id AS box_id, x1, y1, x2, y2,
        row_number() OVER (PARTITION BY id % 20 ORDER BY ((id * 37 % 1009)::DOUBLE / 1009)::FLOAT DESC, id) AS n FROM (SELECT {_BOX} FROM part)),
    k AS (SELECT DISTINCT image_id, 0::BIGINT AS n, []::STRUCT(box_id BIGINT, x1 FLOAT, y1 FLOAT, x2 FLOAT, y2 FLOAT)[] AS kept FROM b
      UNION ALL
      SELECT b.image_id, b.n, CASE WHEN len(list_filter(kept, lambda t:
          ((greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1)))::FLOAT /
           ((t.x2 - t.x1) * (t.y2 - t.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1)))::FLOAT)::FLOAT > 0.3::FLOAT)) = 0
        THEN list_append(kept, {{'box_id': b.box_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) ELSE kept END
      FROM k JOIN b ON b.image_id = k.image_id AND b.n = k.n + 1),
    l AS (SELECT image_id, arg_max(kept, n) AS kept FROM k GROUP BY image_id)
    SELECT image_id, unnest(list_transform(kept, lambda t: t.box_id)) AS box_id, unnest(range(len(kept)))::INTEGER AS rank FROM l"""
)
def nms(spark, sf):
    return I.nms_rows(_scored_boxes(spark, sf), 0.3)


@query()
def reading_order(spark, sf):
    return I.reading_order_rows(_scored_boxes(spark, sf).select("image_id", "box_id", F.col("x1").alias("x"), F.col("y1").alias("y")))


@query()
def db_boxes(spark, sf):
    """Text boxes in maps of 64 x 64 on which some parts draw rectangles."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((64, 64), np.float32)
        for r in pdf.itertuples():
            m[r.y : r.y + 6, r.x : r.x + 14] = 0.5 + (r.id % 50) / 100
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [128], "height": [128], "map_w": [64], "map": [m.ravel()]})

    k = F.col("p_partkey")
    p = _table(spark, sf, "part").select(F.floor(k / 8).cast("long").alias("image_id"), k.alias("id"), (k * 29 % 48).cast("int").alias("x"), (k * 17 % 56).cast("int").alias("y"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small rows, but much work
    return I.text_box_rows(p.repartition(parts, "image_id").groupBy("image_id").applyInPandas(draw, "image_id long, width int, height int, map_w int, map array<float>"))


@query("SELECT c_custkey AS video_id, f::INTEGER AS frame, (f * (c_custkey * 1000)) // 10 AS time_us FROM customer, range(10) r(f) WHERE c_custkey > 0")
def video_frame_times(spark, sf):
    return frame_times(_table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") * 1000).alias("duration_us")))


# batches
@query(
    """WITH f AS (SELECT o_orderkey AS id, (o_orderkey * 7919 % 2000) * 1048576 AS free FROM orders)
    SELECT id, CASE WHEN free < 838860800 THEN 1 WHEN free >= 1677721600 THEN 4 ELSE greatest(1, floor(1 + (free - 838860800)::DOUBLE / 838860800 * 3)::INTEGER) END AS workers FROM f"""
)
def concurrency_level(spark, sf):
    free = (F.col("o_orderkey") * 7919 % 2000) * 1048576
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), B.concurrency(free).alias("workers"))


@query("SELECT batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS batch FROM documents) GROUP BY batch")
def batch_chunks(spark, sf):
    docs = B.batches(_table(spark, sf, "documents").select("doc_id"), "doc_id")
    return docs.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def _pipes(text: str) -> int:
    if "|" in text:
        raise ValueError("a table")
    return len(text)


@query("SELECT contains(text, '|') AS failed, count(*) AS n, sum(CASE WHEN contains(text, '|') THEN 0 ELSE length(text) END)::BIGINT AS total FROM documents GROUP BY 1")
def batch_isolation(spark, sf):
    out = B.isolated(_table(spark, sf, "documents").select("doc_id", "text"), "text", IntegerType(), _pipes)
    return out.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"), F.sum(F.coalesce("output", F.lit(0)).cast("long")).alias("total"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 1700000000000 END AS date, 64 AS dim FROM documents")
def index_documents(spark, sf):
    import uuid

    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    store = ST.EmbeddingStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 64)
    dates = docs.where("id % 2 = 0").select("id", F.col("id").alias("date"))
    B.index_items(store, docs, lambda d: P.embed_rows(d, P.HashEmbedder), dates, 1_700_000_000_000, order="id")
    return store.get().select("id", "date", V.vector_size("embedding").alias("dim"))


@query()
def semantic_search(spark, sf):
    """Benchmark items against documents, both embedded by the stand-in."""
    docs = P.embed_rows(_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), P.HashEmbedder, "text").select("id", "embedding")
    items = P.embed_rows(_table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), P.HashEmbedder, "text").select(F.col("qid").cast("long").alias("qid"), "embedding")
    return S.batch_search(spark, docs, items, 5, 0.3)
