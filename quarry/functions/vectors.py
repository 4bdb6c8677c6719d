"""Vectors as arrays: products, norms, centroids, fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with a guard against zero vectors."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-9))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def distance_to(query: list[float], metric: str = "cosine"):
    """A function of a vector column: its distance to one query, a product a batch instead of a fold a value.

    Vectors of another width, and those with a null component, have none.
    """
    q = np.array(query, dtype=float)
    length = float(np.sqrt((q * q).sum()))

    @arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        sizes = np.asarray(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
        whole = np.flatnonzero(sizes == len(q))
        rows = vectors.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
        if metric == "l2":
            found = np.sqrt(((rows - q) ** 2).sum(axis=1))
        else:
            found = (rows * q).sum(axis=1)
            found = 1 - (found if metric == "dot" else found / np.maximum(np.sqrt((rows * rows).sum(axis=1)) * length, 1e-9))
        out = np.full(len(sizes), np.nan)
        out[whole] = found
        return pa.array(out, mask=np.isnan(out))

    return distance


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def width_is(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def sign_bits(v: Column, bits: int = 64) -> Column:
    """Signs of the first 64 components packed in a long, the first in the lowest bit."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(v, i) > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@arrow_udf(ArrayType(FloatType()))
def from_blob(blob: pa.Array) -> pa.Array:
    """Little-endian 32-bit floats; null where the length is no multiple of 4.  A batch's bytes are read in place, not value by value."""
    none = pc.fill_null(pc.not_equal(pc.bit_wise_and(pc.binary_length(blob.cast(pa.binary())), 3), 0), True)
    blob = pc.if_else(none, pa.scalar(b"", pa.binary()), blob.cast(pa.binary()))
    ends = np.frombuffer(blob.buffers()[1], dtype=np.int32)[blob.offset : blob.offset + len(blob) + 1]
    data = blob.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, dtype=np.uint8)
    places = (ends - ends[0]) // 4 if len(ends) else np.zeros(1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(flat.copy().view("<f4")), mask=none)


@arrow_udf(BinaryType())
def to_blob(vector: pa.Array) -> pa.Array:
    """The reverse of from_blob; a null component is a NaN."""
    ends = vector.offsets.to_numpy()
    flat = vector.values.to_numpy(zero_copy_only=False).astype("<f4")[ends[0] : ends[-1]]
    whole = pa.Array.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(((ends - ends[0]) * 4).astype(np.int32)), pa.py_buffer(flat.tobytes())])
    return pc.if_else(vector.is_valid(), whole, pa.scalar(None, pa.binary()))


def centroid(df: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """The mean of each group's vectors of the right width, made a unit vector.

    Partial sums per component, so a group of any size costs dim numbers a task.
    """
    sums = [F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(dim)]
    means = df.where(width_is(F.col(vector), dim)).groupBy(*by).agg(*sums)
    return means.select(*by, normalized(F.array(*(F.col(f"_{i}") for i in range(dim)))).alias(vector))
