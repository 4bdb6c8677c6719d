"""Ordered logic per group: neighbours, running sums, folds, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def segment_ends(segments: DataFrame, by: list[str], order: str, start: str = "start_ms") -> DataFrame:
    """end_ms of a segment is the next one's start; the last has none."""
    return segments.withColumn("end_ms", F.lead(start).over(Window.partitionBy(*by).orderBy(order)))


def running_before(df: DataFrame, by: list[str], order: list[str], column: str, base: Column | int = 0, name: str = "before") -> DataFrame:
    """base plus the sum of column over the rows before, per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = base if isinstance(base, Column) else F.lit(base)
    return df.withColumn(name, start + F.coalesce(F.sum(column).over(w), F.lit(0)))


def drop_held(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Rows whose normalised text differs from the row before; blank ones go first.

    Comparing with the last *kept* row is the same: a row is dropped only when
    it equals that, so the row before always has its text.
    """
    norm = T.normalized(F.col(text))
    rows = df.withColumn("_norm", norm).where(F.col("_norm") != "")
    before = F.lag("_norm").over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("_norm"))).drop("_norm", "_before")


def drop_near(df: DataFrame, by: str, order: str, vector: str, threshold: float = 0.3) -> DataFrame:
    """Rows at least threshold (Euclidean) from the last kept row of their group; a row without a vector is kept and forgets it.

    What is kept depends on all rows before, so this is a fold in order of
    ``order``: a group's rows pass through one task, which sorts them (and
    spills) and holds a batch and the last kept vector only.
    """
    names = df.columns
    at, vec = names.index(by), names.index(vector)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, begun = None, None, False
        for batch in found:
            column = batch.column(vec)
            ends, valid = column.offsets.to_numpy(), column.is_valid().to_pylist()
            flat = column.values.to_numpy(zero_copy_only=False).astype(float)
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, key in enumerate(batch.column(at).to_pylist()):
                if not begun or key != group:
                    group, last, begun = key, None, True
                if not valid[i]:
                    last = None
                    continue
                v = flat[ends[i] : ends[i + 1]]
                keep[i] = last is None or len(last) != len(v) or float(np.linalg.norm(v - last)) >= threshold
                last = v if keep[i] else last
            yield batch.filter(pa.array(keep))

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, df.schema)


def batches(df: DataFrame, order: list[Column], size: int, by: list[str] | None = None) -> DataFrame:
    """batch: consecutive runs of ``size`` rows."""
    w = (Window.partitionBy(*by) if by else Window).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def round_robin(df: DataFrame, order: list[Column], n: int, by: list[str] | None = None) -> DataFrame:
    """worker: the row's place modulo n."""
    w = (Window.partitionBy(*by) if by else Window).orderBy(*order)
    return df.withColumn("worker", (F.row_number().over(w) - 1) % n)


def frame_times(duration: Column, cap: Column | int, fps: Column | float) -> Column:
    """Evenly spaced stamps in seconds: n = min(cap, max(1, floor(duration * fps))) of them, none for no duration."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    fps = fps if isinstance(fps, Column) else F.lit(fps)
    n = F.least(cap.cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(duration * fps).cast("long")))
    none = F.array().cast("array<double>")
    return F.when((duration > 0) & (n > 0), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * duration / n)).otherwise(none)


def frame_name(seconds: Column) -> Column:
    """The file of a frame: eight digits of rounded milliseconds."""
    return F.format_string("%08d.jpg", F.round(seconds * 1000).cast("long"))


def latest_wins(df: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """One row a key: the first in order of ``newest``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where(F.col("_n") == 1).drop("_n")
