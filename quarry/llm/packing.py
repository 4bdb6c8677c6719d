"""Best-fit packing in a hierarchy of residuals.

Texts are tokenized once and cut into pieces; full pieces are sequences by
themselves.  The rest are packed in rounds: leaves of bounded size pack their
items by best fit, largest first; bins that are nearly full are final, the
others become items of the next round, where several leaves meet in one task;
rounds end when one task has seen all that is left, or nothing got fewer.  A
task never holds more than about ``LEAF_ITEMS`` numbers, however many rows
there are or share a source.

Defined results: a null or empty text is one piece that holds the end id only;
a null doc_id is a row like any other; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, materialize

SIZE = 1024
END_ID = 2
#: Room that a bin may leave and still be final before the last round.
SLACK = 4
LEAF_ITEMS = 40_000
#: Rows of text that are tokenized at a time.
ROWS = 768


def vocabulary() -> str:
    """The tokenizer file's place, where the box that runs the query has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """One encoder for each worker process: its cache of words lives on between tasks."""
    if path not in _ENCODERS:
        from .bpe import FastEncoder

        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]


def cut(docs: DataFrame, path: str, *, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's pieces; only the first may be shorter than size."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = encoder(path).encode(batch.column(1).to_pylist())
        ends = np.cumsum(counts)
        many = (counts + size) // size  # ceil((n + 1) / size)
        row = np.repeat(np.arange(len(counts)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        total = counts + 1
        short = total - (many - 1) * size
        start = np.where(piece > 0, short[row] + (piece - 1) * size, 0)
        length = np.where(piece > 0, size, short[row])
        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B") if len(ids) else b""
        tail = np.array([end_id], dtype="<u4").tobytes()
        at = (ends - counts)[row] + start
        crc = np.zeros(len(row), dtype=np.int64)
        last = piece == many[row] - 1
        for i, (a, n, z) in enumerate(zip(at.tolist(), length.tolist(), last.tolist())):
            crc[i] = zlib.crc32(tail, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if z else zlib.crc32(raw[4 * a : 4 * (a + n)])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", ROWS)


def best_fit(length: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of items by best fit, largest first: the fullest bin that still has room takes an item."""
    order = np.argsort(-length, kind="stable")
    bins, offsets = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(size + 1)]  # bins by the room they have
    rooms = 0  # bit r is set if a bin has room r
    made = 0
    for i, n in zip(order.tolist(), length[order].tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, made
            made += 1
        bins[i], offsets[i] = b, size - room
        left = room - n
        if left:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins, offsets


def _round(items: DataFrame, leaves: int, size: int, slack: int) -> DataFrame:
    """items (item, length, leaf) packed within each leaf: (item, bin, offset, leaf, fill of the bin, open)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)  # the same bins whatever order rows came in
        bins, offset = best_fit(frame["length"].to_numpy(), size)
        item = frame["item"].to_numpy()
        fill = np.bincount(bins, weights=frame["length"]).astype(np.int64)
        head = np.zeros(len(fill), dtype=np.int64)
        head[bins[offset == 0]] = item[offset == 0]
        return pd.DataFrame({"item": item, "bin": head[bins], "offset": offset, "leaf": frame["leaf"].to_numpy(), "fill": fill[bins], "open": fill[bins] < size - slack})

    return items.repartition(leaves, "leaf").groupBy("leaf").applyInPandas(pack, "item bigint, bin bigint, offset bigint, leaf bigint, fill bigint, open boolean")


def pack(pieces: DataFrame, *, size: int = SIZE, slack: int = SLACK, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """pieces, which have length, with sequence_id and offset."""
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < size).select("item", "length")
    left = items.count()
    leaves = max(1, -(-left // leaf_items))
    items = items.withColumn("leaf", F.pmod(F.xxhash64("item"), F.lit(leaves)))
    placed: DataFrame | None = None
    while left:
        done = materialize(_round(items, leaves, size, slack), "round")
        if placed is None:
            placed = done.select("item", "bin", "offset")
        else:  # a bin of the round before moved as a whole
            moved = done.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by"))
            placed = placed.join(moved, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        items = done.where("open and offset = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"), "leaf")
        now = items.count()
        if leaves == 1 or now >= left:
            break
        left, before = now, leaves
        leaves = max(1, -(-left // leaf_items))
        items = items.withColumn("leaf", F.expr(f"leaf * {leaves} div {before}"))  # neighbours meet
    if placed is None:
        return pieces.withColumn("sequence_id", F.col("item")).withColumn("offset", F.lit(0).cast("bigint")).drop("item")
    out = pieces.join(placed, "item", "left")
    return out.withColumn("sequence_id", F.coalesce("bin", "item")).withColumn("offset", F.coalesce("offset", F.lit(0).cast("bigint"))).drop("item", "bin")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every piece of docs with its sequence and its place there."""
    return pack(cut(docs, vocabulary()))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir), sf_dir)
