"""Vector functions as column expressions; nothing here leaves the JVM.

Floats are single precision. A dot product rounds each product to single precision and adds
in double precision from left to right. Quantisation rounds halves up and wraps like a
signed byte. Division by a zero norm gives NaN instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Cols = Column | str
#: Dimensions up to which a product with constants is written out, so that it is compiled.
UNROLL = 160


def _c(x: Cols) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Cols, b: Cols) -> Column:
    """Similarity of two float vectors; a longer right side is cut, a shorter one is an error."""
    a, b = _c(a), _c(b)
    products = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: (x * y).cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda t, x: t + x).cast("float")
    return F.when(F.size(b) < F.size(a), F.raise_error(F.lit("the right vector is shorter"))).otherwise(total)


def dot_const(a: Cols, query: list[float]) -> Column:
    """dot() with a constant vector; for moderate dimensions one compiled sum without lambdas."""
    a = _c(a)
    if len(query) > UNROLL:
        return dot(a, F.array(*[F.lit(float(v)).cast("float") for v in query]))
    total = F.lit(0.0)
    for i, v in enumerate(query):
        total = total + (F.get(a, F.lit(i)) * F.lit(float(v)).cast("float")).cast("double")
    return total.cast("float")


def qdot(a: Cols, b: Cols) -> Column:
    """Similarity of two int8 vectors: the whole-number product over 127 squared."""
    a, b = _c(a), _c(b)
    products = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: (x.cast("int") * y.cast("int")).cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda t, x: t + x).cast("float")
    return (total / F.lit(16129.0).cast("float")).cast("float")


def qdot_const(a: Cols, query: list[int]) -> Column:
    a = _c(a)
    if len(query) > UNROLL:
        return qdot(a, F.array(*[F.lit(int(v)).cast("tinyint") for v in query]))
    total = F.lit(0)
    for i, v in enumerate(query):
        total = total + F.get(a, F.lit(i)).cast("int") * F.lit(int(v))
    return (total.cast("float") / F.lit(16129.0).cast("float")).cast("float")


def quantize(v: Cols) -> Column:
    """Float vector to int8; NaN is an error."""

    def one(x: Column) -> Column:
        whole = F.floor((x * F.lit(127.0).cast("float")).cast("double") + 0.5)
        wrapped = (F.pmod(whole + 128, F.lit(256)) - 128).cast("tinyint")
        return F.when(F.isnan(x), F.raise_error(F.lit("a vector with NaN cannot be quantised"))).otherwise(wrapped)

    return F.transform(_c(v), one)


def dequantize(v: Cols) -> Column:
    return F.transform(_c(v), lambda b: (b.cast("float") / F.lit(127.0).cast("float")).cast("float"))


def norm(v: Cols) -> Column:
    square = F.aggregate(_c(v), F.lit(0.0).cast("float"), lambda t, x: (t + (x * x).cast("float")).cast("float"))
    return F.sqrt(square.cast("double")).cast("float")


def normalize(v: Cols) -> Column:
    v = _c(v)
    # the norm stands in an array of one, so that it is computed once a row
    return F.flatten(
        F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, F.when(x == 0, F.lit(float("nan"))).otherwise(x.cast("double") * F.lit(float("inf")))).otherwise(x / n).cast("float")))
    )


def normalize_q(v: Cols) -> Column:
    return quantize(normalize(dequantize(v)))


def distance(a: Cols, b: Cols) -> Column:
    """Inner-product distance: one minus dot()."""
    return (F.lit(1.0).cast("float") - dot(a, b)).cast("float")


def to_encoding(v: Cols, source: str, target: str) -> Column:
    """A vector column of encoding source ("f32" or "qint8") in encoding target."""
    if source == target:
        return _c(v)
    return quantize(v) if target == "qint8" else dequantize(v)


def flatten_vectors(vectors: Cols, dim: int) -> Column:
    """An array of vectors as one, with dim elements of each; shorter ones are an error."""
    cut = F.transform(_c(vectors), lambda v: F.when(F.size(v) < dim, F.raise_error(F.lit("a vector is shorter than the dimension"))).otherwise(F.slice(v, 1, dim)))
    return F.flatten(cut)


def unflatten_vector(flat: Cols, dim: int) -> Column:
    """Consecutive vectors of dim elements; a remainder is dropped."""
    flat = _c(flat)
    n = F.floor(F.size(flat) / dim).cast("int")
    return F.when(n < 1, F.slice(F.array(flat), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * dim + 1, F.lit(dim))))


def vector_size(v: Cols) -> Column:
    return F.size(_c(v))


_SQL = {
    "vec_dot": "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN cast(aggregate(zip_with(a, b, (x, y) -> cast(x * y AS DOUBLE)), 0D, (t, x) -> t + x) AS FLOAT)",
    "vec_qdot": "(a ARRAY<TINYINT>, b ARRAY<TINYINT>) RETURNS FLOAT RETURN cast(cast(aggregate(zip_with(a, b, (x, y) -> cast(cast(x AS INT) * cast(y AS INT) AS DOUBLE)), 0D, (t, x) -> t + x) AS FLOAT) / 16129F AS FLOAT)",
    "vec_quantize": "(v ARRAY<FLOAT>) RETURNS ARRAY<TINYINT> RETURN transform(v, x -> cast(pmod(floor(cast(x * 127F AS DOUBLE) + 0.5D) + 128, 256) - 128 AS TINYINT))",
    "vec_dequantize": "(v ARRAY<TINYINT>) RETURNS ARRAY<FLOAT> RETURN transform(v, b -> cast(cast(b AS FLOAT) / 127F AS FLOAT))",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Registers temporary SQL functions of these names."""
    for name, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(_SQL)
