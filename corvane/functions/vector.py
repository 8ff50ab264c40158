"""Vector scalars: higher-order functions over array<double>, and Arrow codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))).otherwise(F.when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays. The norm is the variable of an outer lambda: used in the inner one as it is, it would
    be computed again for each component."""
    return F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))[0]


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a norm is 0; vectors of different lengths raise an error."""
    bottom = F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)) * _sum(F.transform(doubles(b), lambda x: x * x)))
    return F.when(bottom == 0, 0.0).otherwise(dot(a, b) / bottom)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def conditional_similarity(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull(), cosine_similarity(a, b)).otherwise(0.0)


def truncate_and_normalize(v: Column, dims: int) -> Column:
    if dims <= 0:
        raise ValueError(f"dims must be positive, got {dims}")
    return normalize(F.slice(doubles(v), 1, dims))


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(v.cast("array<string>"), ","), F.lit("]"))


def vector_cast(text: Column) -> Column:
    return F.from_json(text, "array<double>")


@F.pandas_udf(T.BinaryType())
def serialize(v: pd.Series) -> pd.Series:
    """Little-endian 4-byte floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def deserialize(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(bytes(x), "<f4").astype(np.float64))


def of_dims(vector: Column, dims: int) -> Column:
    """The vector, which has to have ``dims`` components (a null stays null)."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, not "), F.size(vector).cast("string")))
    return F.when(vector.isNull() | (F.size(vector) == dims), vector).otherwise(wrong)
