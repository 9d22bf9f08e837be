"""Vector functions: dot product, norms, and the float32 little-endian codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>")


def dot(a: Column, b: Column) -> Column:
    """Products in float32, summed in float64; null for unequal lengths."""
    products = F.zip_with(a, b, lambda x, y: (x * y).cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector in float32; null for the zero vector."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def encode(v: Column | str) -> Column:
    @F.pandas_udf(BinaryType())
    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(v)


def decode(blob: Column | str) -> Column:
    """Null where the bytes are no vector: none, or not a multiple of four."""

    @F.pandas_udf(ArrayType(FloatType()))
    def unpacked(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or not len(b) or len(b) % 4 else np.frombuffer(b, "<f4"))

    return unpacked(blob)


def similarities(df: DataFrame, vector_col: str, query: list[float], name: str = "similarity") -> DataFrame:
    """``df`` with the dot product of each vector with ``query``, by blocks in NumPy.

    For large corpora: one matrix product per Arrow batch instead of an
    interpreted fold per row.  Vectors of another length get null."""
    q = np.asarray(query, dtype=np.float32)

    @F.pandas_udf(DoubleType())
    def sim(vs: pd.Series) -> pd.Series:
        ok = vs.map(lambda v: v is not None and len(v) == len(q))
        out = pd.Series(np.full(len(vs), np.nan), dtype="float64")
        if ok.any():
            block = np.stack(vs[ok].to_numpy()).astype(np.float32)
            out[ok.to_numpy()] = (block * q).astype(np.float64).sum(axis=1)
        return out.astype(object).where(out.notna(), None).astype("Float64")

    return df.withColumn(name, sim(vector_col))
