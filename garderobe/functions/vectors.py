"""Dense vectors as array columns, and the little-endian float codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def dense_cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty or zero vectors."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.when(usable, dot(a, b) / scale).otherwise(0.0)


def embedding_similarity(a: Column, b: Column) -> Column:
    missing = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(missing, 0.5).otherwise((dense_cosine(a, b) + 1) / 2)


def l2_normalize(v: Column) -> Column:
    length = norm(v)
    return F.when(length == 0, F.transform(as_double(v), lambda x: F.lit(0.0))).otherwise(
        F.transform(as_double(v), lambda x: x / length)
    )


def dense_to_sparse(v: Column) -> Column:
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: i.cast("string")), as_double(v))


def sparse_to_dense(m: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(m[i.cast("string")], F.lit(0.0)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(blob: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to vectors; a torn blob is an error."""
    def one(raw):
        if raw is None:
            return None
        if len(raw) % 4:
            raise ValueError(f"vector blob of {len(raw)} bytes is not a multiple of 4")
        return np.frombuffer(raw, dtype="<f4")

    return blob.map(one)


@F.pandas_udf(T.BinaryType())
def encode_floats(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


@F.pandas_udf(T.DoubleType())
def pair_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of row pairs, one matrix product per Arrow batch; NULL on either side stays NULL."""
    out = pd.Series(np.nan, index=a.index)
    both = a.notna() & b.notna()
    if both.any():
        x, y = _matrix(a[both]), _matrix(b[both])
        scale = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        dots = np.einsum("ij,ij->i", x, y)
        out[both] = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return out.where(both, None)
