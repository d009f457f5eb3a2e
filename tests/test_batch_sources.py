import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql.types import IntegerType

from vecspark import schema as S
from vecspark.operators import batch as B
from vecspark.operators import providers as P
from vecspark.operators.store import EmbeddingStore
from vecspark.sources import embstore as E
from vecspark.sources.media import frame_times, image_files


@pytest.fixture
def double():
    def f(x):  # inside, so that it is pickled by value
        if x in (2, 4):
            raise ValueError(f"bad {x}")
        return x * 2

    return f


def test_failures_fail_alone(spark, double):
    errors, done = [], []
    listener = B.Listener(on_error=lambda item, e: errors.append(item), on_complete=done.append)
    p = B.BatchProcessor("x", IntegerType(), double, listener)
    m = p.run(spark.createDataFrame([(i,) for i in range(1, 5)], "x int"))
    assert isinstance(m, B.Success) and m.total_processed == 2 and sorted(errors) == [2, 4] and done == [m]
    assert sorted(r["output"] for r in p.result.collect()) == [2, 6]


def test_empty_and_outer_failure(spark, double):
    p = B.BatchProcessor("x", IntegerType(), double)
    assert p.run(spark.createDataFrame([], "x int")).total_processed == 0
    failed = []
    p = B.BatchProcessor("x", IntegerType(), double, B.Listener(on_batch_complete=lambda b: 1 / 0, on_fail=failed.append))
    m = p.run(spark.createDataFrame([(1,)], "x int"))
    assert isinstance(m, B.Failure) and isinstance(m.error, ZeroDivisionError) and failed == [m]


def test_numbering(spark):
    d = spark.range(1003).selectExpr("id * 3 % 1009 AS k").repartition(5)
    rows = sorted((r["k"], r["row"]) for r in B.numbered(d, "k").collect())
    assert [r[1] for r in rows] == list(range(1003))
    assert {r["batch"]: r["count"] for r in B.batches(d, "k").groupBy("batch").count().collect()} == {i: min(10, 1003 - i * 10) for i in range(101)}
    assert B.numbered(d.where("false"), "k").count() == 0


def test_concurrency():
    mb = 1 << 20
    assert [B.concurrency(x * mb) for x in (100, 800, 1199, 1334, 1600, 9000)] == [1, 1, 2, 3, 4, 4]


def test_indexers(spark, tmp_path):
    store = EmbeddingStore(spark, f"file://{tmp_path}/s", 16, "qint8")
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, content string")
    embed = lambda d: P.embed_rows(d, lambda: P.HashEmbedder(16))
    dates = spark.createDataFrame([(1, 77)], "id long, date long")
    assert B.index_items(store, items, embed, dates, 5) == 3
    assert {r["id"]: r["date"] for r in store.get().collect()} == {1: 77, 2: 5, 3: 5}
    frames = spark.createDataFrame([(7, 0, "x"), (7, 1, "y"), (8, 0, "z")], "id long, frame int, content string")

    class Picky(P.HashEmbedder):
        def _embed(self, item):
            if item == "z":
                raise ValueError
            return super()._embed(item)

    assert B.index_videos(store, frames, lambda d: P.embed_rows(d, lambda: Picky(16)), dates, 5) == 1
    assert store.get([7]).count() == 1


def test_providers(spark):
    e = P.HashEmbedder()
    with pytest.raises(S.ModelNotInitialised):
        e.embed("x")
    e.initialize()
    assert np.linalg.norm(e.embed("Hello world!")) == pytest.approx(1, abs=1e-3) and e.embed("a" * 2000).shape == (64,)
    d = P.embed_rows(spark.createDataFrame([(1, "x"), (2, "y")], "id int, content string"), P.HashEmbedder)
    assert d.where("size(embedding) = 64 AND error IS NULL").count() == 2

    class Ones(P.Model):
        def load(self):
            pass

        def run(self, inputs):
            return {"out": np.ones((1, 512), np.float32)}

    image = P.clip_image(Ones())
    image.initialize()
    assert np.linalg.norm(image.embed(np.zeros((30, 20, 3), np.uint8))) == pytest.approx(1, abs=1e-3)
    with pytest.raises(S.InvalidTextEmbedderResourceFiles):
        P.MiniLmText(Ones(), {"a": 1})
    text = P.MiniLmText(Ones(), {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2})
    text.initialize()
    assert text.embed("a b").shape == (384,)
    with pytest.raises(S.InvalidModelFile):
        P.OnnxModel("/nowhere.onnx").load()


def test_detector_and_reader():
    class Faces(P.Model):
        def load(self):
            pass

        def run(self, inputs):
            return {"scores": np.float32([[[0.1, 0.9], [0.2, 0.8], [0.5, 0.5]]]), "boxes": np.float32([[[0, 0, 0.5, 0.5], [0, 0, 0.5, 0.49], [0.5, 0.5, 1, 1]]])}

    d = P.FaceDetector(Faces())
    with pytest.raises(S.ModelNotInitialised):
        d.detect(np.zeros((10, 20, 3), np.uint8))
    d.initialize()
    boxes, scores = d.detect(np.zeros((10, 20, 3), np.uint8))
    assert [b.tolist() for b in boxes] == [[0, 0, 10, 5]] and scores == pytest.approx([0.9])

    class Map(P.Model):
        def load(self):
            pass

        def run(self, inputs):
            m = np.zeros(inputs["x"].shape[2:], np.float32)
            m[20:40, 20:80] = 0.9
            return {"m": m[None, None]}

    class Letters(P.Model):
        def load(self):
            pass

        def run(self, inputs):
            p = np.full((len(inputs["x"]), 3, 3), 0.1, np.float32)
            p[:, [0, 1, 2], [1, 0, 2]] = 0.8
            return {"p": p}

    r = P.TextReader(Map(), Letters(), ["a", "b"])
    r.initialize()
    (found,) = r.read(np.zeros((96, 128, 3), np.uint8))
    assert found["text"] == "ab" and found["confidence"] == pytest.approx(0.8) and len(found["points"]) == 4
    with pytest.raises(S.InvalidInput):
        r.read(np.zeros((0, 0, 3), np.uint8))


def test_model_manager(spark, tmp_path):
    reg = {"m": P.ModelInfo("m", P.ModelType.TEXT, "u", "m/model.onnx", ("vocab.txt",)), "n": P.ModelInfo("n", P.ModelType.IMAGE, "u2", "n.onnx")}
    z = tmp_path / "m.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("model.onnx", b"1")
    man = P.ModelManager(f"{tmp_path}/models", reg, fetch=lambda url: b"model")
    with pytest.raises(S.InvalidModelFile):
        man.import_file("m", str(z))
    with zipfile.ZipFile(z, "a") as f:
        f.writestr("vocab.txt", b"2")
    man.import_file("m", str(z))
    assert man.exists("m") and man.list() == ["m"] and man.list(P.ModelType.IMAGE) == []
    with pytest.raises(S.ModelNotDownloaded):
        man.model_file("n")
    assert man.download("n").read_bytes() == b"model" and man.list(P.ModelType.IMAGE) == ["n"]
    assert man.delete("m") and not man.exists("m") and man.table(spark).count() == 2
    with pytest.raises(S.InvalidModelType):
        man.exists("x")


@pytest.mark.parametrize("kind", ["f32", "qint8"])
def test_binary_round_trip(spark, tmp_path, kind):
    spark.dataSource.register(E.EmbeddingFileSource)
    cast = "float" if kind == "f32" else "tinyint"
    df = spark.range(25).selectExpr("id", "id * 100 AS date", f"transform(sequence(1, 4), x -> cast(x + id AS {cast})) AS embedding")
    opts = {"dim": "4", "encoding": kind}
    df.repartition(3).write.format("embstore").options(**opts).mode("overwrite").save(f"{tmp_path}/b")
    back = spark.read.format("embstore").options(**opts, records="4").load(f"{tmp_path}/b")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert back.schema["embedding"].dataType.elementType.typeName() == ("float" if kind == "f32" else "byte")


def test_binary_files(tmp_path):
    path = f"{tmp_path}/x.bin"
    v = np.arange(8, dtype=np.float32).reshape(2, 4)
    E.write_file(path, np.array([1, 2]), np.array([10, 20]), v)
    assert E.checked_count(path, 4, S.Encoding.F32) == 2
    E.append_file(path, np.array([3]), np.array([30]), v[:1])
    assert E.update_file(path, np.array([2, 9]), np.array([99, 0]), v) == 1
    got = np.fromfile(path, E.record_type(4, S.Encoding.F32), offset=4)
    assert got["id"].tolist() == [1, 2, 3] and got["date"].tolist() == [10, 99, 30]
    q = f"{tmp_path}/q.bin"
    E.write_file(q, np.array([1]), np.array([1]), np.zeros((1, 4), np.int8))
    with pytest.raises(S.CodecMismatch):
        E.checked_count(q, 4, S.Encoding.F32)
    with open(path, "r+b") as f:
        f.write(struct.pack("<i", 2**31 - 1))
    with pytest.raises(S.InvalidEmbeddingStoreFile):
        E.checked_count(path, 4, S.Encoding.F32)
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(S.InvalidEmbeddingStoreFile):
        E.checked_count(f"{tmp_path}/short", 4, S.Encoding.F32)


def test_int8_files_are_about_four_times_smaller(tmp_path):
    n = 1000
    E.write_file(f"{tmp_path}/f", np.arange(n), np.arange(n), np.zeros((n, 512), np.float32))
    E.write_file(f"{tmp_path}/q", np.arange(n), np.arange(n), np.zeros((n, 512), np.int8))
    import os

    assert round(os.path.getsize(f"{tmp_path}/f") / os.path.getsize(f"{tmp_path}/q")) == 4


def test_media(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    assert [bytes(r["content"]) for r in image_files(spark, f"{tmp_path}", "*.png").collect()] == [b"x"]
    v = spark.createDataFrame([(1, 1000), (2, 0)], "video_id long, duration_us long")
    assert [r["time_us"] for r in frame_times(v, 4).orderBy("frame").collect()] == [0, 250, 500, 750]


def test_the_stand_in_keeps_few_and_short_words():
    e = P.HashEmbedder(8)
    e.initialize()
    e.embed("x" * 5000 + " y")
    assert list(e._places) == ["y"]
    e.embed(" ".join(map(str, range(250_000))))
    assert len(e._places) <= 200_000
