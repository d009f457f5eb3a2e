import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import geometry as G
from vecspark.functions import image as I
from vecspark.functions import text as T
from vecspark.schema import ConfigParseFailed


def test_cleaners_and_frames(spark):
    d = spark.createDataFrame([("Hello, World! it's 42é",)], "t string")
    assert d.select(T.clip_clean("t")).first()[0] == "hello world its 42"
    assert d.select(T.minilm_clean("t")).first()[0] == "hello , world ! it ' s 42é"
    ids = spark.createDataFrame([([5, 6],), (list(range(100)),)], "ids array<int>")
    short, long = [r[0] for r in ids.select(T.clip_frame("ids")).collect()]
    assert short == [49406, 5, 6, 49407] + [0] * 73 and len(long) == 77 and 49407 not in long
    i, m = T.minilm_frame("ids", 101, 102, 6)
    rows = ids.select(i.alias("i"), m.alias("m")).collect()
    assert rows[0]["i"] == [101, 5, 6, 102, 0, 0] and rows[0]["m"] == [1, 1, 1, 1, 0, 0]
    assert rows[1]["i"] == [101, 0, 1, 2, 3, 4] and rows[1]["m"] == [1] * 6


def test_wordpiece_keeps_pieces_before_the_unknown():
    w = T.WordPiece({"[UNK]": 0, "un": 1, "##aff": 2, "##able": 3, "a": 4})
    assert w.tokens("unaffable a") == ["un", "##aff", "##able", "a"]
    assert w.tokens("unz") == ["un", "[UNK]"] and w.tokens("") == []


def test_bpe_merges_lowest_rank_first(tmp_path):
    vocab = {"a": 0, "b": 1, "ab": 2, "ab ": 3, "abab ": 4, "b ": 5, "a ": 6}
    t = T.ClipBpe(vocab, {("a", "b "): 0, ("a", "b"): 1, ("ab", "ab "): 2})
    assert t.merge("abab") == ["abab "] and t.merge("a") == ["a "] and t.merge("aab") == ["a", "ab "]
    assert t.ids("abab a") == [4, 6]
    (tmp_path / "m").write_text("#version\na b</w>\nx\n")
    (tmp_path / "v").write_text('{"b</w>": 7}')
    assert T.clip_merges(f"{tmp_path}/m") == {("a", "b "): 0} and T.clip_vocab(f"{tmp_path}/v") == {"b ": 7}


def test_configs():
    assert T.MiniLmConfig.parse('{"do_lower_case": false}') == T.MiniLmConfig(lower=False)
    with pytest.raises(ConfigParseFailed):
        T.MiniLmConfig.parse("{")
    text = "Global:\n  x: 1\nPostProcess:\n  name: CTC\n  character_dict:\n  - a\n  - '''''\n  - \"\\u00e9\"\n  - '#'\nOther: 1\n"
    assert T.characters(text) == ["a", "''", "é", "#", " "]
    with pytest.raises(ConfigParseFailed):
        T.characters("PostProcess:\n  name: x\n")


def test_ctc(spark):
    steps = [1, 1, 0, 1, 2, 9, 3]
    rows = [(1, t, c, 0.9 if c == best else 0.1) for t, best in enumerate(steps) for c in range(10)] + [(2, 0, 0, 0.9)]
    got = {r["b"]: (r["text"], r["confidence"]) for r in T.ctc_decode(spark.createDataFrame(rows, "b int, t int, c int, p float"), ["a", "b", "c"]).collect()}
    assert got[1] == ("aabc", pytest.approx(0.9)) and got[2] == ("", 0)
    tie = spark.createDataFrame([(1, 0, 2, 0.5), (1, 0, 1, 0.5)], "b int, t int, c int, p float")
    assert T.ctc_decode(tie, ["a", "b"]).first()["text"] == "a"


def test_iou_and_nms():
    a = np.float32([0, 0, 2, 2])
    assert I.iou(a, [[0, 0, 2, 2], [1, 0, 3, 2], [5, 5, 6, 6], [0, 0, 0, 0]]).tolist() == pytest.approx([1, 1 / 3, 0, 0])
    boxes = np.float32([[0, 0, 2, 2], [0, 0, 2, 2.1], [1, 0, 3, 2]])
    assert I.nms(boxes, [0.5, 0.9, 0.5], 0.3) == [1, 2] or I.nms(boxes, [0.5, 0.9, 0.5], 0.3) == [1]
    third = np.float32(1) / np.float32(3)
    assert I.nms(boxes[[0, 2]], [0.5, 0.5], third) == [0, 1]  # equal to the limit stays
    assert I.nms(np.zeros((0, 4)), [], 0.5) == []


def test_sizes(spark):
    d = spark.createDataFrame([(2000, 1000), (100, 4000), (10, 10)], "w int, h int")
    got = [tuple(r[0]) for r in d.select(G.scaled_dimensions(F.col("w"), F.col("h"))).collect()]
    assert got == [(1024, 512), (25, 1024), (10, 10)]
    got = [tuple(r[0]) for r in d.select(G.multiple_of_32(F.col("w"), F.col("h"), 960, "max", 4000)).collect()]
    assert got == [(960, 480), (32, 960), (32, 32)]
    with pytest.raises(ValueError):
        G.multiple_of_32(F.col("w"), F.col("h"), 1, "x", 1)
    assert [r[0] for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(G.half_even(F.col("x"))).collect()] == [0, 2, 2]


def test_pixels_and_crops():
    img = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(6, 4, 3)
    assert I.center_crop(img, 4).tolist() == img[1:5].tolist()
    assert [c.shape for c in I.crop_boxes(img, [(-1, -1, 2, 2), (3, 3, 3, 9)])] == [(2, 2, 3)]
    assert I.clip_pixels(img, 8).shape == (3, 8, 8) and I.face_pixels(img).shape == (3, 240, 320)
    assert I.face_pixels(np.full((2, 2, 3), 127, np.uint8)).max() == 0
    rgb, bgr = I.det_pixels(img, "RGB", (0, 0, 0), (1, 1, 1)), I.det_pixels(img, "BGR", (0, 0, 0), (1, 1, 1))
    assert np.array_equal(rgb[0], bgr[2]) and I.rec_pixels(img, 48, 64).shape == (3, 48, 64)
    drawn = I.draw_boxes(np.zeros((9, 9, 3), np.uint8), [(2, 2, 6, 6)], (255, 0, 0), stroke=1)
    assert drawn[2, 2, 0] == 255 and drawn[4, 4, 0] == 0


def test_components_and_boxes():
    m = np.zeros((40, 60), np.float32)
    m[5:15, 10:40] = 0.9
    m[30, 50] = 0.9
    assert [len(c) for c in I.connected(m > 0.5)] == [300, 1]
    diagonal = np.eye(3, dtype=bool)
    assert len(I.connected(diagonal)) == 1
    assert I.dilate(np.eye(3, dtype=bool)).tolist() == [[True, True, False], [True, True, True], [False, True, True]]
    cx, cy, w, h, angle = I.main_axes_rect(I.connected(m > 0.5)[0])
    assert (cx, cy, w, h, angle) == pytest.approx((24.5, 9.5, 29, 9, 0))
    (box,) = I.text_boxes(m, 120, 80)
    d = 29 * 9 * 1.5 / (2 * 38)
    assert box[:, 0].min() == round((24.5 - 14.5 - d) * 2) and box[:, 1].max() == round((9.5 + 4.5 + d) * 2)
    assert I.text_boxes(m * 0.5, 120, 80) == []
    with pytest.raises(ValueError):
        I.text_boxes(m, 1, 1, box_type="poly")


def test_quads_and_crops(spark):
    quad = np.array([(20, 20), (0, 0), (20, 0), (0, 20)], np.float64)
    assert I.quad_order(quad).tolist() == [[0, 0], [20, 0], [20, 20], [0, 20]]
    img = np.zeros((40, 40, 3), np.uint8)
    img[:20, :20] = 200
    assert I.quad_crop(img, quad).mean() > 190 and I.quad_crop(img, np.array([(0, 0), (10, 0), (10, 30), (0, 30)], float)).shape[:2] == (10, 30)
    h = I.homography(np.array([(0, 0), (1, 0), (1, 1), (0, 1)]), np.array([(0, 0), (2, 0), (2, 2), (0, 2)]))
    assert np.allclose(h, np.diag([2, 2, 1]))
    p = spark.createDataFrame([([(20.0, 20.0), (0.0, 0.0), (20.0, 0.0), (0.0, 20.0)],)], "p array<struct<x:float,y:float>>")
    assert [tuple(x) for x in p.select(G.quad_order(F.col("p"))).first()[0]] == [(0, 0), (20, 0), (20, 20), (0, 20)]
    assert np.array_equal(I.corner_order(quad), np.array([[0, 0], [0, 20], [20, 20], [20, 0]]))
    grown = I.unclip(np.array([(0, 0), (10, 0), (10, 10), (0, 10)]), 1.0)
    assert grown[:, 0].min() == pytest.approx(-2.5) and grown[:, 0].max() == pytest.approx(12.5)


def test_reading_order():
    assert I.reading_order([(50, 12), (10, 10), (5, 60), (30, 5)]) == [1, 3, 0, 2]
    assert I.reading_order([]) == []


def test_images_are_dealt_by_number(spark, sf):
    from vecspark.plans import catalog

    # else adaptive execution puts these small rows into one task
    assert "REPARTITION_BY_NUM" in catalog.queries()["db_boxes"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_components_keep_their_order_at_edges():
    mask = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool)
    assert [p.tolist() for p in I.connected(mask)] == [[[0, 0], [1, 1], [0, 2]], [[3, 0], [3, 1]]]


def test_long_words_are_not_kept(monkeypatch):
    word = "a" * 5000
    pieces = T.WordPiece({"[UNK]": 0, "a": 1, "##a": 2})
    assert pieces.ids(f"{word} a") == [1, *[2] * 4999, 1] and list(pieces._known) == ["a"]
    bpe = T.ClipBpe({"a": 0, "a ": 1}, {})
    assert bpe.ids(f"{word} a") == [*[0] * 4999, 1, 1] and list(bpe._known) == ["a"]
    monkeypatch.setattr(T, "KNOWN_WORDS", 3)
    assert pieces.ids("a b c d e f") == [1, 0, 0, 0, 0, 0] and len(pieces._known) <= 4
