"""Vector expressions over array columns, in double precision. Vectors of unequal length are compared on their common part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Floor and weight of the caption's part, as published by the data model.
CAPTION_FLOOR, CAPTION_WEIGHT = 0.55, 0.9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, even where ``use`` names it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, added up from the first component on; null if a side is null."""
    a, b = doubles(a), doubles(b)
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def centered(v: Column | str, mean: Column | str) -> Column:
    return F.zip_with(doubles(v), doubles(mean), lambda x, m: x - F.coalesce(m, F.lit(0.0)))


def present(v: Column | str) -> Column:
    """A vector that is there: neither null (never computed) nor empty (failed)."""
    return F.coalesce(F.size(col(v)), F.lit(-1)) > 0


def hybrid_score(query: Column | str, image: Column | str, caption: Column | str) -> Column:
    """Image similarity plus what the caption's similarity has above a floor, weighted."""
    extra = F.when(present(caption), F.greatest(F.lit(0.0), dot(query, caption) - CAPTION_FLOOR) * CAPTION_WEIGHT).otherwise(F.lit(0.0))
    return dot(query, image) + extra


def max_cosine(v: Column | str, others: Column | str) -> Column:
    """The largest inner product with a list of vectors; -1 for an empty list."""
    return F.coalesce(F.array_max(F.transform(col(others), lambda o: dot(col(v), o))), F.lit(-1.0))


def pair_space(model_a: Column, visual_a: Column, model_b: Column, visual_b: Column, active: str) -> Column:
    """``visual`` if both rows have a visual vector of the active model, else ``primary``."""
    both = (model_a == active) & (model_b == active) & present(visual_a) & present(visual_b)
    return F.when(F.coalesce(both, F.lit(False)), "visual").otherwise("primary")


def mean_vector(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Component-wise mean per key: components are averaged map-side first, so only one row a component and key is shuffled."""
    parts = df.select(*keys, F.posexplode(doubles(vector)).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    pairs = F.array_sort(F.collect_list(F.struct("_pos", "_x")))
    return parts.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_x"]).alias("mean"))


def mean_pool(df: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return mean_vector(df, vector, keys).withColumn("mean", unit("mean"))


def vector_scores(df: DataFrame, vector: str, queries: np.ndarray, out: str = "scores") -> DataFrame:
    """``df`` with the products of each row's vector with a small fixed matrix of queries, by NumPy in Arrow batches."""
    matrix = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(queries, dtype=np.float64))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            width = matrix.value.shape[1]
            yield pd.Series([list(matrix.value[:, : len(v)] @ np.asarray(v[:width], dtype=np.float64)) if v is not None and len(v) else [] for v in batch])

    return df.withColumn(out, product(F.col(vector)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary column; null if the length is no multiple of 4."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(bytes(b), "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode_floats(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())
