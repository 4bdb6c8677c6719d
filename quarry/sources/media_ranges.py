"""Boxes of media files by reading ranges: headers first, then only the boxes that hold an index.

A file of any size costs some bytes a box: a walk goes from header to header,
its payloads are passed over.  What it finds - the index of segments, the
fragments' heads - becomes rows with their place in the file, which are dealt
over all tasks before their bytes are read, so fragments of one large file are
parsed in many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import media
from .listing import opened

BOXES = "path string, kind string, position bigint, size bigint"
#: The largest box whose bytes are read; larger ones are no index.
LARGEST = 64 << 20
KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def walked(path: str) -> Iterator[tuple[str, str, int, int]]:
    """(path, kind, position, size) of a file's top-level boxes; a cut or broken box ends the walk."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        end, place = f.size(), 0
        while place + 8 <= end:
            head = f.read_at(min(16, end - place), place)
            size, kind = struct.unpack_from(">I4s", head)
            least = 8
            if size == 1:
                if len(head) < 16:
                    return
                size, least = struct.unpack_from(">Q", head, 8)[0], 16
            elif size == 0:
                size = end - place
            if size < least or place + size > end:
                return
            yield path, kind.decode("latin-1"), place, size
            place += size


def box_rows(files: DataFrame) -> DataFrame:
    """The top-level boxes of files (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for row in walked(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _batch(rows, BOXES)
                        rows = []
                yield _batch(rows, BOXES)

    return files.select("path").mapInArrow(run, BOXES)


def _read(boxes: DataFrame, kind: str, parse, schema: str) -> DataFrame:
    """parse of each box of a kind; equal shares of the boxes go to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, position, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = opened(path)
                with system.open_input_file(at) as f:
                    data = f.read_at(size, position)
                try:
                    rows = [(path, i, *r) for i, r in enumerate(parse(data, position))]
                except struct.error:  # cut short inside
                    rows = []
                yield _batch(rows, schema)

    some = boxes.where((F.col("kind") == kind) & (F.col("size") <= LARGEST)).select("path", "kind", "position", "size")
    return some.repartition("path", "position").mapInArrow(run, schema)


def segments(files: DataFrame) -> DataFrame:
    """The media segments of each file's first index, as media.segment_rows gives them."""
    first = box_rows(files).where("kind = 'sidx'").groupBy("path", "kind").agg(F.min_by(F.struct("position", "size"), "position").alias("b")).select("path", "kind", "b.*")

    def parse(data: bytes, position: int) -> list[tuple]:
        return [(place + position, size, pts, duration) for place, size, pts, duration in media.segment_index(data)]

    return _read(first, "sidx", parse, media.SEGMENTS)


def samples(files: DataFrame) -> DataFrame:
    """The samples of all fragments of files, with their place in the file; seq counts within a fragment."""
    return _read(box_rows(files), "moof", media.fragment_samples, media.SAMPLES)
