"""Running sums and last values within a key, however many rows a key has.

A window over a key is one task's.  Here rows lie in ranges of (key, order);
each task works through its range, and what a key's rows leave open at the end
of a range - sums and last values, a row a task - is carried on to the next
ranges of that key.  One key's rows are thus spread over as many tasks as their
number asks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..sources.shared import kept


def _groups(keys: pa.Array, before: object, begun: bool) -> tuple[np.ndarray, bool]:
    """(first row of each run of one key, whether the first run goes on from the rows before)."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return starts, begun and keys[0].as_py() == before


def scanned(df: DataFrame, key: str, order: list[Column], *, sums: tuple[str, ...] = (), last: tuple[str, ...] = (), name: str = "scan") -> DataFrame:
    """df with upto_<c> for each of sums, the sum of c, and last_<c> for each of last, the last value of c that is not null:
    over the key's rows up to this one in the given order.  Sums are of longs."""
    spark, columns = df.sparkSession, df.columns
    schema = df.schema
    added = [StructField(f"upto_{c}", LongType()) for c in sums] + [StructField(f"last_{c}", schema[c].dataType) for c in last]
    out = StructType([*(StructField(f.name, f.dataType) for f in schema.fields), *added, StructField("_part", IntegerType()), StructField("_edge", StructType([StructField("opens", schema[key].dataType)]))])
    shape = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begun, opens, before = TaskContext.get().partitionId(), False, None, None
        held = dict.fromkeys(sums, 0)
        seen = {c: None for c in last}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            starts, goes_on = _groups(keys, before, begun)
            if not begun:
                opens, begun = keys[0].as_py(), True
            before = keys[n - 1].as_py()
            first = np.repeat(starts, np.diff(np.append(starts, n)))
            made: list[pa.Array] = []
            for c in sums:
                values = batch.column(c).fill_null(0).to_numpy().astype(np.int64)
                run_ = np.cumsum(values)
                base = run_[starts] - values[starts]
                if goes_on:
                    base[0] -= held[c]
                run_ = run_ - np.repeat(base, np.diff(np.append(starts, n)))
                held[c] = int(run_[-1])
                made.append(pa.array(run_))
            for c in last:
                column = batch.column(c)
                at = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                none = at < first
                at = np.where(none, n, at)
                if not goes_on:
                    at = np.where(none, -1, at)
                elif len(starts) > 1:
                    at = np.where(none & (first >= starts[1]), -1, at)
                both = pa.concat_arrays([column, pa.array([seen[c] if goes_on else None], column.type)])
                found = both.take(pa.array(np.where(at < 0, 0, at), mask=at < 0))
                seen[c] = found[n - 1].as_py()
                made.append(found)
            edge = pa.nulls(n, shape.field("_edge").type)
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*batch.columns, *made, pa.array(np.full(n, part, dtype=np.int32)), edge], shape)], schema=shape)
        if begun:  # what the range leaves open
            row = {c: None for c in columns} | {key: before, "_part": part, "_edge": {"opens": opens}} | {f"upto_{c}": held[c] for c in sums} | {f"last_{c}": seen[c] for c in last}
            yield pa.RecordBatch.from_pylist([row], schema=shape)

    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    done = kept(ranged.mapInArrow(run, out), name)
    names = [f.name for f in added]
    ends = done.where(F.col("_edge").isNotNull()).select("_part", F.col("_edge.opens").alias("opens"), F.col(key).alias("closes"), *names).orderBy("_part").collect()  # a row a task
    carried, open_key, open_ = [], None, None
    for part, opens, closes, *ours in ends:
        goes_on = open_ is not None and opens == open_key
        if goes_on:
            carried.append((part, opens, *open_))
            if closes == opens:
                ours = [a + b for a, b in zip(ours[: len(sums)], open_[: len(sums)])] + [a if a is not None else b for a, b in zip(ours[len(sums) :], open_[len(sums) :])]
        open_key, open_ = closes, ours
    rows = done.where(F.col("_edge").isNull()).drop("_edge")
    if not carried:
        return rows.drop("_part")
    extra = spark.createDataFrame(carried, StructType([StructField("_in", IntegerType()), StructField("_of", schema[key].dataType), *(StructField(f"_{f.name}", f.dataType) for f in added)]))
    rows = rows.join(F.broadcast(extra), (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_of")), "left")  # a row a task at most
    whole = [(F.col(f"upto_{c}") + F.coalesce(F.col(f"_upto_{c}"), F.lit(0))).alias(f"upto_{c}") for c in sums] + [F.coalesce(F.col(f"last_{c}"), F.col(f"_last_{c}")).alias(f"last_{c}") for c in last]
    return rows.select(*columns, *whole)


def previous(df: DataFrame, key: str, order: list[Column], column: str, name: str) -> DataFrame:
    """df with the value of column in the key's row before, null in its first: a lag whose key may hold any share of the rows."""
    boxed = df.withColumn("_box", F.struct(F.col(column).alias("v"))).withColumn("_nth", F.lit(1).cast("long"))
    numbered = scanned(boxed, key, order, sums=("_nth",), name="numbered").withColumnRenamed("upto__nth", "_n").drop("_nth")
    # A row's value counts from the next place on: halves between places keep both in one order.
    shifted = numbered.select(F.col(key).alias("_k"), (2 * F.col("_n") + 1).alias("_at"), F.col("_box"), F.lit(None).cast(numbered.drop("_box").select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    own = numbered.select(F.col(key).alias("_k"), (2 * F.col("_n")).alias("_at"), F.lit(None).cast(numbered.schema["_box"].dataType).alias("_box"), F.struct(*numbered.drop("_box").columns).alias("_row"))
    both = scanned(own.unionByName(shifted), "_k", [F.col("_at")], last=("_box",), name="lagged")
    return both.where(F.col("_row").isNotNull()).select("_row.*", F.col("last__box.v").alias(name)).drop("_n")
