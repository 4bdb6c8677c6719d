"""ISO media boxes: the segment index and fragments' samples, as rows.

The layouts are those of ISO/IEC 14496-12.  Each file's head or fragment is one
row of ``binaryFile``; its boxes are read with numpy and come out as many rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENTS = "path string, seq int, position bigint, size bigint, pts_ms double, duration_ms double"
SAMPLES = "path string, seq int, position bigint, size bigint, dts bigint, pts bigint, duration bigint, is_sync boolean"


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, box start, payload start, end) of the boxes of data[start:end]; a cut or broken box ends it."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start, start + head, start + size
        start += size


def segment_index(data: bytes) -> list[tuple[int, int, float, float]]:
    """(position, size, pts in ms, duration in ms) of each media segment of the first sidx; references to other indexes are passed over."""
    for kind, _, at, end in boxes(data):
        if kind != b"sidx":
            continue
        version = data[at]
        scale = struct.unpack_from(">I", data, at + 8)[0]
        wide = version > 0
        pts, offset = struct.unpack_from(">QQ" if wide else ">II", data, at + 12)
        at += 28 if wide else 20
        count = struct.unpack_from(">H", data, at + 2)[0]
        if not scale or at + 4 + 12 * count > end:
            return []
        refs = np.frombuffer(data, dtype=">u4", count=3 * count, offset=at + 4).reshape(count, 3).astype(np.int64)
        size, duration = refs[:, 0] & 0x7FFFFFFF, refs[:, 1]
        place = end + offset + np.cumsum(size) - size
        time = pts + np.cumsum(duration) - duration
        media = refs[:, 0] >> 31 == 0
        return [(int(p), int(s), t * 1000 / scale, d * 1000 / scale) for p, s, t, d, m in zip(place, size, time.tolist(), duration.tolist(), media) if m]
    return []


def _is_sync(flags: int) -> bool:
    """By the dependency bits where they say, else by the non-sync bit."""
    depends = flags >> 24 & 3
    return depends == 2 if depends else not flags >> 16 & 1


def fragment_samples(data: bytes, position: int = 0) -> list[tuple[int, int, int, int, int, bool]]:
    """(position, size, dts, pts, duration, is sync) of the samples of each track run of data, which lies at position in its file."""
    out: list[tuple[int, int, int, int, int, bool]] = []
    for kind, moof, at, end in boxes(data):
        if kind != b"moof":
            continue
        for kind, _, at, stop in boxes(data, at, end):
            if kind == b"traf":
                out += _track(data, at, stop, position + moof)
    return out


def _track(data: bytes, at: int, end: int, base: int) -> list[tuple[int, int, int, int, int, bool]]:
    defaults = {"duration": 0, "size": 0, "flags": 0}
    dts, out, after = 0, [], None
    for kind, _, p, stop in boxes(data, at, end):
        if kind == b"tfhd":
            flags = struct.unpack_from(">I", data, p)[0] & 0xFFFFFF
            q = p + 8
            if flags & 0x1:
                base = struct.unpack_from(">Q", data, q)[0]
                q += 8
            for bit, name in ((0x2, None), (0x8, "duration"), (0x10, "size"), (0x20, "flags")):
                if flags & bit:
                    if name:
                        defaults[name] = struct.unpack_from(">I", data, q)[0]
                    q += 4
        elif kind == b"tfdt":
            dts = struct.unpack_from(">Q" if data[p] else ">I", data, p + 4)[0]
        elif kind == b"trun":
            word, n = struct.unpack_from(">II", data, p)
            version, flags = word >> 24, word & 0xFFFFFF
            q, first = p + 8, None
            place = after if after is not None else base
            if flags & 0x1:
                place = base + struct.unpack_from(">i", data, q)[0]
                q += 4
            if flags & 0x4:
                first = struct.unpack_from(">I", data, q)[0]
                q += 4
            fields = [f for f, bit in (("duration", 0x100), ("size", 0x200), ("flags", 0x400), ("shift", 0x800)) if flags & bit]
            if q + 4 * len(fields) * n > stop:
                continue
            table = np.frombuffer(data, dtype=">u4", count=len(fields) * n, offset=q).reshape(n, len(fields)).astype(np.int64)
            column = {f: table[:, i] for i, f in enumerate(fields)}
            duration = column.get("duration", np.full(n, defaults["duration"]))
            size = column.get("size", np.full(n, defaults["size"]))
            mark = column.get("flags", np.full(n, defaults["flags"])).copy()
            if first is not None and "flags" not in column and n:
                mark[0] = first
            shift = column.get("shift", np.zeros(n, dtype=np.int64))
            shift = np.where(shift >> 31, shift - (1 << 32), shift) if version else shift
            time, spot = dts + np.cumsum(duration) - duration, place + np.cumsum(size) - size
            out += [(int(a), int(s), int(t), int(t + h), int(d), _is_sync(int(m))) for a, s, t, h, d, m in zip(spot, size, time, shift, duration, mark)]
            dts += int(duration.sum())
            after = place + int(size.sum())
    return out


def _explode(read, schema: str, files: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, i, *r) for i, r in enumerate(read(content or b""))]
                except struct.error:  # a file cut short inside a box has no rows
                    rows = []
                columns = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return files.select("path", "content").mapInArrow(run, schema)


def segment_rows(files: DataFrame) -> DataFrame:
    """Segments of files (path, content)."""
    return _explode(segment_index, SEGMENTS, files)


def sample_rows(files: DataFrame) -> DataFrame:
    """Samples of fragments (path, content)."""
    return _explode(fragment_samples, SAMPLES, files)
