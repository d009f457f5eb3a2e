import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark import kernels as K
from vecspark.functions import vector as V

FLOATS = "v array<float>"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_dot_rounds_products_in_single_precision(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 64)).astype(np.float32)
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(np.float32(x * y))
    assert one(spark, "a array<float>, b array<float>", (a.tolist(), b.tolist()), V.dot("a", "b")) == np.float32(total) == K.dot(a, b)
    assert one(spark, FLOATS, (a.tolist(),), V.dot_const("v", b.tolist())) == np.float32(total)


def test_dot_lengths(spark):
    assert one(spark, "a array<float>, b array<float>", ([1.0], [2.0, 9.0]), V.dot("a", "b")) == 2
    with pytest.raises(Exception, match="shorter"):
        one(spark, "a array<float>, b array<float>", ([1.0, 1.0], [2.0]), V.dot("a", "b"))


def test_dot_const_beyond_the_unrolled_size(spark):
    v = [0.5] * (V.UNROLL + 1)
    assert one(spark, FLOATS, (v,), V.dot_const("v", v)) == np.float32(0.25 * len(v))


def test_quantize_rounds_halves_up_and_wraps(spark):
    v = [0.0, 1.0, -1.0, 0.5 / 127, -0.5 / 127, 1.5 / 127, -1.5 / 127, 1.01, -1.02]
    got = one(spark, FLOATS, (v,), V.quantize("v"))
    assert got == K.quantize(np.float32(v)).tolist()
    assert got[:3] == [0, 127, -127] and got[7] == -128 and got[8] == 126
    assert got[3:7] == [1, 0, 2, -1]


def test_quantize_refuses_nan(spark):
    with pytest.raises(Exception, match="NaN"):
        one(spark, FLOATS, ([float("nan")],), V.quantize("v"))
    with pytest.raises(ValueError):
        K.quantize(np.float32([np.nan]))


def test_normalize(spark):
    got = one(spark, FLOATS, ([3.0, 4.0],), V.normalize("v"))
    assert got == pytest.approx([0.6, 0.8])
    assert all(math.isnan(x) for x in one(spark, FLOATS, ([0.0, 0.0],), V.normalize("v")))
    assert np.isnan(K.normalize(np.zeros(3, np.float32))).all()


def test_normalize_matches_the_kernel_bit_for_bit(spark):
    v = np.random.default_rng(3).normal(size=50).astype(np.float32)
    assert one(spark, FLOATS, (v.tolist(),), V.normalize("v")) == K.normalize(v).tolist()


def test_int8(spark):
    a, b = [127, -128, 5], [127, 3, -7]
    want = np.float32(np.float32(127 * 127 - 128 * 3 - 35) / np.float32(16129))
    assert one(spark, "a array<tinyint>, b array<tinyint>", (a, b), V.qdot("a", "b")) == want == K.dot(np.int8(a), np.int8(b))
    assert one(spark, "a array<tinyint>", (a,), V.qdot_const("a", b)) == want
    assert one(spark, "a array<tinyint>", (a,), V.dequantize("a")) == K.dequantize(np.int8(a)).tolist()
    assert one(spark, "a array<tinyint>", (a,), F.size(V.normalize_q("a"))) == 3


def test_flatten_and_back(spark):
    assert one(spark, "v array<array<float>>", ([[1.0, 2.0, 9.0], [3.0, 4.0]],), V.flatten_vectors("v", 2)) == [1, 2, 3, 4]
    assert one(spark, FLOATS, ([1.0, 2.0, 3.0, 4.0, 5.0],), V.unflatten_vector("v", 2)) == [[1, 2], [3, 4]]
    assert one(spark, FLOATS, ([1.0],), V.unflatten_vector("v", 2)) == []
    with pytest.raises(Exception, match="shorter"):
        one(spark, "v array<array<float>>", ([[1.0]],), V.flatten_vectors("v", 2))


def test_conversions_keep_their_own_encoding(spark):
    assert one(spark, FLOATS, ([1.0],), V.to_encoding("v", "f32", "f32")) == [1]
    assert one(spark, FLOATS, ([1.0],), V.to_encoding("v", "f32", "qint8")) == [127]
    assert one(spark, "v array<tinyint>", ([127],), V.to_encoding("v", "qint8", "f32")) == [1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1, 1, width=32), min_size=1, max_size=20))
def test_quantize_round_trip_is_within_half_a_step(v):
    x = np.float32(v)
    assert np.abs(K.dequantize(K.quantize(x)) - x).max() <= 0.5 / 127 + 1e-6


def test_update_prototype():
    p = K.normalize(np.float32([1, 1]))
    got, n = K.update_prototype(p, np.float32([[1, 0]]), 2)
    assert n == 3 and np.allclose(got, K.normalize(2 * p + np.float32([1, 0])))
    fresh, n = K.update_prototype(p, np.float32([[0, 2]]), 0)
    assert n == 1 and fresh.tolist() == [0, 1]
    with pytest.raises(ValueError):
        K.update_prototype(p, np.zeros((0, 2), np.float32), 1)
