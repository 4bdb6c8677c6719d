"""What the operators share: tables, the shared folder, Arrow batches, word positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: what stands between spaces, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text a Python worker holds at a time (Arrow's own setting counts rows, not bytes).
TEXT_ROWS = 256
#: Bytes of text it holds at a time, unless one row has more.
TEXT_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver share no folder")
        named = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these, once nothing reads them any more."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text of a column; 0 for other kinds."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column) or not wide and not pa.types.is_string(column.type) and not pa.types.is_binary(column.type):
        return np.zeros(len(column), dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets).astype(np.int64)


def sliced(batch: pa.RecordBatch, rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows and about TEXT_BYTES."""
    upto = np.cumsum(sum((_sizes(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        room = TEXT_BYTES + (upto[at - 1] if at else 0)
        end = max(at + 1, min(at + rows, int(np.searchsorted(upto, room, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = TEXT_ROWS) -> DataFrame:
    """mapInArrow with fn called on slices of at most so many rows and about TEXT_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, rows):
                yield fn(part)

    return df.mapInArrow(run, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes end to end, start, end) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    return raw, offsets[:-1], offsets[1:]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of texts that lie end to end in buf."""
    n = len(buf)
    inside = ~_BLANK[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[start[start < n]] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    ws = np.flatnonzero(first)
    we = np.flatnonzero(last) + 1
    row = np.searchsorted(end, ws, side="right")
    return ws, we, row


def word_count(text: Column) -> Column:
    """Words of a text as long, 0 for null; inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tidy(value: Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))
