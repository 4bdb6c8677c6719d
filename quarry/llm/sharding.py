"""Sharding by a lookup table that shards fill in turn.

Each shard orders the slots of a prime-sized table by a permutation of its own
(offset and skip); shards take turns and claim the next free slot they prefer.
A key's slot is its hash modulo the table's size, so placing a row is one
lookup; when a shard goes, the keys of the others hardly move.

The table is a fixed parameter, ``TABLE_SIZE`` entries of one small number,
whatever the data's size, so it is broadcast.

Defined results: a null key goes to the slot of its own hash value; repeated
keys land together; an empty table gives an empty result; other columns pass, but a table that
has a column ``slot`` or ``shard`` is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SHARDS = 64
#: A prime, well over a hundred slots per shard.
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of its shard in names."""
    if not names or len(set(names)) != len(names) or size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("names are distinct, one at least, and size is a prime")
    offset = [_number(f"{n}/offset") % size for n in names]
    skip = [_number(f"{n}/skip") % (size - 1) + 1 for n in names]
    table = np.full(size, -1, dtype=np.int32)
    turn = list(offset)
    filled = 0
    while filled < size:
        for i in range(len(names)):
            while table[turn[i]] >= 0:
                turn[i] = (turn[i] + skip[i]) % size
            table[turn[i]] = i
            filled += 1
            if filled == size:
                break
    return table


def place(df: DataFrame, keys: list[str], names: list[str], *, size: int = TABLE_SIZE) -> DataFrame:
    """df with slot and shard (an index into names); columns of df with these names, in any case, are refused."""
    if {c.lower() for c in df.columns} & {"slot", "shard"}:
        raise ValueError("df has a column slot or shard already; rename it first")
    spark = df.sparkSession
    table = lookup_table(names, size)
    slots = spark.createDataFrame([(i, int(s)) for i, s in enumerate(table)], "slot long, shard int")
    keyed = df.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(size)).cast("long"))
    return keyed.join(F.broadcast(slots), "slot")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def write_shards(df: DataFrame, keys: list[str], names: list[str], path: str) -> None:
    """df written as Parquet, a folder for each shard; a shard's rows are split among tasks, so none is one task's."""
    placed = place(df, keys, names)
    placed.repartition("slot").drop("slot").write.partitionBy("shard").parquet(path)


def op5_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all its columns, its slot and its shard."""
    placed = place(documents(spark, sf_dir), ["doc_id"], shard_names())
    return placed.select("doc_id", "slot", "shard", *(c for c in placed.columns if c not in ("doc_id", "slot", "shard")))
