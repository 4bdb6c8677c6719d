"""Token ids as files: a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by every file.  A block
holds the ids of whole documents; its ids are dealt round robin to ``LANES``
interleaved coder states that share one stream of 32-bit words.  Every
``SPAN`` ids the block's header keeps a checkpoint, the states and the place in
the stream, so a block decodes in parallel from each of them, and a checksum
closes each block.  Files are written in ascending order of doc_id: file k
holds ids below those of file k+1.

numpy codes many blocks at once, a step of all their lanes at a time.  Files
go to the shared folder through pyarrow's file systems, under a temporary name
first, so a task that is run again leaves the same file.

Defined results: a null or empty text is the end id alone; null doc_ids come
first; repeated rows are documents of their own; an empty table makes no file
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import gather
from .common import documents, map_arrow, materialize, shared_dir
from .packing import ROWS, encoder, vocabulary

END_ID = 0
SCALE = 20
LANES = 32
SPAN = 16_384
BLOCK_TOKENS = 65_536
GROUP_BLOCKS = 32
#: Steps of all lanes whose frequencies are looked up at a time.
STEPS = 64
#: Ids in a file, about.
FILE_TOKENS = 8_000_000
LOW = np.uint64(1 << 31)
MAGIC = b"QRB1"
HEAD = struct.Struct("<4sIIIIQ")


class Table:
    """Frequencies that sum to 2**SCALE, at least 1 for every id that occurs."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        cum = np.concatenate([[0], np.cumsum(self.freq)])
        self.cum = cum[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def fit(cls, counts: np.ndarray) -> Table:
        whole, some = 1 << SCALE, counts > 0
        if not some.any():
            counts, some = np.ones(1, dtype=np.int64), np.ones(1, dtype=bool)
        spare = whole - int(some.sum())
        if spare < 0:
            raise ValueError(f"more than {whole} distinct ids")
        exact = counts * (spare / counts.sum())
        freq = some + np.floor(exact).astype(np.int64)
        left = whole - int(freq.sum())
        order = np.lexsort((np.arange(len(counts)), -(exact - np.floor(exact)) * some))
        freq[order[:left]] += 1
        return cls(freq)

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the frequency table's checksum differs")
        return cls(np.frombuffer(raw[:-4], dtype="<u4").astype(np.int64))


def encode_blocks(table: Table, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]) -> list[bytes]:
    """Each block (doc ids, null flags, ids per document, ids, ids before it in its file) as bytes."""
    size = np.array([len(b[3]) for b in blocks])
    steps = int(-(-size.max() // LANES)) if len(size) else 0
    # Places after a block's last id have the whole range as their frequency, which leaves a state as it is.
    freq, cum = np.append(table.freq, np.uint64(1 << SCALE)), np.append(table.cum, np.uint64(0))
    grid = np.full((len(blocks), steps * LANES), len(table.freq), dtype=np.int32)
    for i, b in enumerate(blocks):
        grid[i, : len(b[3])] = b[3]
    grid = grid.reshape(len(blocks), steps, LANES)
    x = np.full((len(blocks), LANES), LOW, dtype=np.uint64)
    words, out = np.empty((steps, *x.shape), dtype="<u4"), np.empty((steps, *x.shape), dtype=bool)
    per = SPAN // LANES
    marks: dict[int, np.ndarray] = {}
    shift, q = np.empty_like(x), np.empty_like(x)
    for low in range((steps - 1) // STEPS * STEPS, -1, -STEPS):
        sym = np.ascontiguousarray(grid[:, low : low + STEPS].transpose(1, 0, 2))
        f, c = freq[sym], cum[sym]
        most, rest = f << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - f
        for k in range(len(sym) - 1, -1, -1):
            s = low + k
            np.greater_equal(x, most[k], out=out[s])
            words[s] = x  # the low 32 bits
            np.multiply(out[s], np.uint64(32), out=shift)
            np.right_shift(x, shift, out=x)
            # (x // f << SCALE) + x % f + c
            np.floor_divide(x, f[k], out=q)
            np.multiply(q, rest[k], out=q)
            x += q
            x += c[k]
            if s % per == 0:
                marks[s] = x.copy()
    number = out.sum(axis=2)
    total = number.sum(axis=0)
    before = np.cumsum(number, axis=0) - number
    result = []
    for i, (doc, null, each, ids, base) in enumerate(blocks):
        spots = range(0, int(-(-len(ids) // LANES)), per)
        body = [HEAD.pack(MAGIC, len(doc), len(ids), int(total[i]), len(spots), base), doc.astype("<i8").tobytes(), null.astype("u1").tobytes(), each.astype("<u4").tobytes()]
        body += [struct.pack("<I", int(before[s, i])) + marks[s][i].astype("<u8").tobytes() for s in spots]
        body.append(words[:, i][out[:, i]].tobytes())
        raw = b"".join(body)
        result.append(raw + struct.pack("<I", zlib.crc32(raw)))
    return result


def decode_blocks(table: Table, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """The inverse of encode_blocks; all spans between checkpoints at once."""
    heads, streams, states, begins, counts = [], [], [], [], []
    shift = 0
    for raw in raws:
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum differs")
        magic, docs, n, words, spots, base = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = HEAD.size
        doc = np.frombuffer(raw, "<i8", docs, at)
        null = np.frombuffer(raw, "u1", docs, at + 8 * docs)
        each = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        heads.append((doc, null, each, n, base))
        for k in range(spots):
            begins.append(struct.unpack_from("<I", raw, at)[0] + shift)
            states.append(np.frombuffer(raw, "<u8", LANES, at + 4))
            counts.append(min(SPAN, n - k * SPAN))
            at += 4 + 8 * LANES
        streams.append(np.frombuffer(raw, "<u4", words, at))
        shift += words
    if not states:
        return [(d, z, e, np.zeros(0, dtype=np.uint32), b) for d, z, e, _, b in heads]
    stream = np.concatenate([*streams, np.zeros(1, dtype=np.uint32)]).astype(np.uint64)
    n = np.array(counts)
    order = np.argsort(-n, kind="stable")  # the spans that still have ids at a step come first
    x, at = np.array(states)[order], np.array(begins)[order]
    steps = -(-n[order] // LANES)
    flat = np.zeros((len(n), int(steps[0]) * LANES), dtype=np.uint32)
    mask, last = np.uint64((1 << SCALE) - 1), len(stream) - 1
    live = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
    for s, k in enumerate(live.tolist()):
        slot = x[:k] & mask
        sym = table.symbol[slot]
        flat[:k, s * LANES : (s + 1) * LANES] = sym
        y = x[:k] >> np.uint64(SCALE)
        y *= table.freq[sym]
        y += slot
        y -= table.cum[sym]
        # Lanes after a span's last id read anything: they are the last ones of its last step.
        take = y < LOW
        where = np.flatnonzero(take)
        many = take.sum(axis=1)
        place = np.arange(len(where)) + (at[:k] - (np.cumsum(many) - many))[where // LANES]
        some = y.reshape(-1)
        some[where] = (some[where] << np.uint64(32)) | stream[np.minimum(place, last)]
        x, at = y, at[:k] + many
    begin = np.empty(len(n), dtype=np.int64)
    begin[order] = np.arange(len(n)) * flat.shape[1]
    flat = gather(flat.reshape(-1), begin, n)
    cuts = np.concatenate([[0], np.cumsum([h[3] for h in heads])])
    return [(d, z, e, flat[cuts[i] : cuts[i + 1]], b) for i, (d, z, e, _, b) in enumerate(heads)]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, ids) of every row: little-endian 16-bit ids with the end id, 32-bit ones if any needs them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path).encode(batch.column(1).to_pylist())
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        kind, ends = ("<u4" if wide else "<u2"), np.cumsum(counts)
        tail, width = np.array([end_id], dtype=kind).tobytes(), 4 if wide else 2
        raw = ids.astype(kind).tobytes()
        cells = [raw[width * (e - n) : width * e] + tail for e, n in zip(ends.tolist(), counts.tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts + 1), pa.array(cells, type=pa.binary())], ["doc_id", "n", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, n bigint, ids binary", ROWS)


def _ids(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, dtype="<u2" if len(cell) == 2 * n else "<u4")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all of tokens; as many numbers as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            # A batch is counted as a whole: a count of each cell costs as much as the vocabulary is long.
            kinds: dict[bool, list[bytes]] = {}
            for cell, n in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                kinds.setdefault(len(cell) == 2 * n, []).append(cell)
            for narrow, cells in kinds.items():
                part = np.bincount(np.frombuffer(b"".join(cells), dtype="<u2" if narrow else "<u4"))
                if len(part) > len(total):
                    total = np.concatenate([total, np.zeros(len(part) - len(total), dtype=np.int64)])
                total[: len(part)] += part
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "times"])

    rows = tokens.select("n", "ids").mapInArrow(run, "id bigint, times bigint").groupBy("id").agg(F.sum("times").alias("times")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["times"].to_numpy(dtype=np.int64)
    return counts


def file_system(uri: str):
    """(file system, path) of a folder named by the session."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_files(tokens: DataFrame, table: Table, folder: str) -> DataFrame:
    """Writes tokens (doc_id, n, ids) as files in ascending order; returns (file, offset, bytes, ids) of every block."""
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-int(total) // FILE_TOKENS))
    raw = table.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = Table.from_bytes(raw), []
        number = TaskContext.get().partitionId()
        fs, top = file_system(folder)
        name = f"{top}/{number:06d}.rans"
        draft = f"{name}.{uuid.uuid4().hex}"
        state = {"at": 0, "base": 0, "held": 0}
        ready: list[tuple] = []
        docs: list[int | None] = []
        cells: list[np.ndarray] = []

        def close_block() -> None:
            if docs:
                each = np.array([len(c) for c in cells])
                ready.append((np.array([d or 0 for d in docs]), np.array([d is None for d in docs]), each, np.concatenate(cells).astype(np.int64), state["base"]))
                state["base"] += int(each.sum())
                state["held"] = 0
                docs.clear()
                cells.clear()

        def flush(out) -> None:
            for block, coded in zip(ready, encode_blocks(own, ready)):
                index.append((state["at"], len(coded), len(block[3])))
                out.write(coded)
                state["at"] += len(coded)
            ready.clear()

        some = False
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for d, n, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    some = True
                    docs.append(d)
                    cells.append(_ids(cell, n))
                    state["held"] += n
                    if state["held"] >= BLOCK_TOKENS:
                        close_block()
                        if len(ready) >= GROUP_BLOCKS or len(ready[-1][3]) > 4 * BLOCK_TOKENS:
                            flush(out)
            close_block()
            if ready:
                flush(out)
        fs.move(draft, name) if some else fs.delete_file(draft)
        at, size, ids = zip(*index) if index else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int64()), *(pa.array(c, pa.int64()) for c in (at, size, ids))], ["file", "offset", "bytes", "ids"])

    fs, top = file_system(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/table.freq") as out:
        out.write(raw)
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    return materialize(ordered.mapInArrow(run, "file bigint, offset bigint, bytes bigint, ids bigint"), "rans-index")


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """(file, base, doc_id, before, n_tokens, ids_crc32) of every document in the files, decoded by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(folder)
        with fs.open_input_stream(f"{top}/table.freq") as f:
            table = Table.from_bytes(f.read())
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns)))
            for k in range(0, len(rows), GROUP_BLOCKS):
                group, raws, now, source = rows[k : k + GROUP_BLOCKS], [], None, None
                for number, at, size, _ in group:
                    if number != now:
                        if source is not None:
                            source.close()
                        source, now = fs.open_input_file(f"{top}/{number:06d}.rans"), number
                    raws.append(source.read_at(size, at))
                if source is not None:
                    source.close()
                for (number, *_), (doc, null, each, ids, base) in zip(group, decode_blocks(table, raws)):
                    ends = np.cumsum(each)
                    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), number)), pa.array(doc, mask=null.astype(bool)), pa.array(base + ends - each), pa.array(each), pa.array(crc, pa.int64())], ["file", "doc_id", "before", "n_tokens", "ids_crc32"])

    slots = max(1, index.sparkSession.sparkContext.defaultParallelism)
    return index.repartition(4 * slots, "file", "offset").mapInArrow(run, "file bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document as read back from the files it writes to folder."""
    tokens = materialize(tokenized(docs, path), "tokens")
    index = write_files(tokens, Table.fit(count_ids(tokens)), folder)
    # One row per file.
    files = index.groupBy("file").agg(F.sum("ids").alias("own")).withColumn("base", F.sum("own").over(Window.orderBy("file")) - F.col("own")).select("file", "base")
    return read_files(index, folder).join(files, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary(), f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}")
