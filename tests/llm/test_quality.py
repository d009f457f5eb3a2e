import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_helpers import prose, rows_of
from vecspark.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op1_quality(spark, sf).toPandas().set_index("doc_id")
    known = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"].dropna()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    held = got[got["held_out"]].join(known, how="inner")
    assert len(held) > 50 and ((held["score"] >= 0.3) == (held["quality"] == 1)).mean() > 0.9


def test_only_texts_and_allowed_labels_count(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    base = rows_of(Q.scored(spark, docs.select("doc_id", "text"), Q.train(docs, labels)))
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).repartition(7)
    assert rows_of(Q.scored(spark, moved.select("doc_id", "text"), Q.train(moved, flipped))) == base


def test_statistics_do_not_depend_on_neighbours():
    texts = [prose(1, 50), "", None, "One two. One two!\n\nOne two.", "a" * 5000, "| | |\n| | |", prose(2, 9) + "\n" + prose(2, 9)]
    together = Q.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.array_equal(Q.statistics(pa.array([t], pa.string()))[0], together[i])
    by_name = dict(zip(Q.FEATURES, together.T, strict=True))
    assert by_name["repeat_lines"][6] == 0.5 and by_name["log_words"][3] == np.float32(np.log1p(6)) and by_name["distinct_words"][0] == len(set(texts[0].split())) / 50
    assert not together[1].any() and not together[2].any()


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(int)
    t = Q.fit(x, y, rounds=12)

    def walk(row):
        total = t.base
        for node in t.root:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(row) for row in x], t.score(x))
    assert ((Q.fit(x, y).score(x) >= 0.5) == y).mean() > 0.95


def test_messy_rows(spark, messy, labels):
    out = Q.scored(spark, messy, Q.train(messy, labels))
    assert out.count() == messy.count() and out.columns[:-1] == messy.columns
    kept = Q.keep_good(spark, messy, labels)
    assert kept.columns == messy.columns and kept.dtypes == messy.dtypes
    nothing = Q.train(messy, labels.where("false"))
    assert {r[0] for r in Q.scored(spark, messy, nothing).select("_score").collect()} == {0.5}
    assert Q.keep_good(spark, messy.where("false"), labels).count() == 0
