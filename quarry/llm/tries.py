"""Prefix trie of conversations: which turns they share from the start.

A node is a distinct sequence of first turns; it is named by its depth and by
four sums of 32 bits each, over its turns, of hashes of (place, turn), so
names are running sums and a conversation of any length is dealt over tasks.

1. *Running sums* within a conversation go over rows in ranges of (conversation,
   order): each task sums inside its range, the ranges' open ends (a row a
   task) are carried on, so one long conversation is not one task's.
2. *Ends*: conversations that end at the same node are one class; its least id
   walks for all of them, with their number as weight.  Lists of ids are cut
   into segments in order, which one stream hashes; no list is held whole.
3. *Partial tries*: each task combines the rows of its conversations into a
   node table; the tables are merged by node in rounds, ``FAN`` tables into one,
   until one is left: a node that all conversations pass is a row a table.
4. *Rollup*: a node belongs to its least member.  What belongs to a
   conversation is the lower end of its path (deeper nodes have fewer members),
   so sums from the leaf up along a path give what it adds to each of its
   nodes' subtrees, and one more merge by node adds these up: a fixed number of
   passes at any depth.

Defined results: rows with a null conv_id are of no conversation and are left
out; a null role or text is the empty string; turns are ordered null first,
turns of one number by a hash of role and text; repeated rows are turns of
their own; a conversation without turns ends at the root; no conversations, no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Rows that a task combines at a time; tables that become one in a round of merging (a power of two), and rounds before the last.
ROWS, FAN, ROUNDS = 100_000, 16, 2
#: Conversations in a segment of a list of ids.
SEGMENT = 50_000
#: First turns that may come from another conversation are fewer than this; one in so many conversations lends them.
HEADS, LENDER = 6, 100
SUMS = ["k1", "k2", "k3", "k4"]
NODE = ["depth", *SUMS]
PARENT = ["up1", "up2", "up3", "up4"]


def running(df: DataFrame, key: str, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """df with upto_<s> for each s of sums: the sum of s over the key's rows up to this one, in the given order.

    Ranges of (key, order) are summed apart; of each range only its first and
    last key and the sums of the last one go to the driver, a row a task.
    """
    spark = df.sparkSession
    upto = [f"upto_{s}" for s in sums]
    ranged = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    columns = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, held = TaskContext.get().partitionId(), None, None, np.zeros(len(sums), dtype=np.int64)
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            lengths = np.diff(np.append(starts, len(keys)))
            first = int(keys[0]) if first is None else first
            runs = []
            for i, s in enumerate(sums):
                values = batch.column(s).to_numpy().astype(np.int64)
                run = np.cumsum(values)
                before = run[starts] - values[starts]
                if last == keys[0]:
                    before[0] -= held[i]
                run -= np.repeat(before, lengths)
                held[i] = run[-1]
                runs.append(run)
            last = int(keys[-1])
            n = batch.num_rows
            out = [*batch.columns, *map(pa.array, runs), pa.array(np.full(n, part, dtype=np.int32)), pa.nulls(n, pa.int64())]
            yield (made := pa.RecordBatch.from_arrays(out, names=[*columns, *upto, "part", "opens"]))
            schema = made.schema
        if schema is not None:  # the range's open end
            row = {c: None for c in columns} | {key: last, "part": part, "opens": first} | dict(zip(upto, held.tolist()))
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    done = materialize(ranged.mapInArrow(scan, f"{kinds}, {', '.join(f'{u} long' for u in upto)}, part int, opens long"), name)
    ends = done.where(F.col("opens").isNotNull()).select("part", "opens", F.col(key).alias("closes"), *upto).orderBy("part").collect()  # a row a task
    carried, open_key, open_sums = [], None, None
    for part, opens, closes, *sums_of in ends:
        if opens == open_key:
            carried.append((part, opens, *open_sums))
            if closes == opens:
                sums_of = [a + b for a, b in zip(sums_of, open_sums)]
        open_key, open_sums = closes, sums_of
    rows = done.where(F.col("opens").isNull()).drop("opens")
    if not carried:
        return rows.drop("part")
    extra = spark.createDataFrame(carried, f"part int, {key} long, {', '.join(f'add_{u} long' for u in upto)}")
    rows = rows.join(F.broadcast(extra), ["part", key], "left")  # a row a task at most
    return rows.select(*columns, *((F.col(u) + F.coalesce(F.col(f"add_{u}"), F.lit(0))).alias(u) for u in upto))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, len, turns) of every turn of the rebuilt conversations, and (conv_id, turns) of each conversation."""
    role, text = tidy(F.col("role")), tidy(F.col("text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("second"), text, role).alias("t2"), F.length(text).cast("long").alias("len"), F.lit(1).cast("long").alias("one")
    )
    placed = running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")], ["one"], "turns").withColumnRenamed("upto_one", "nth")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % LENDER
    counted = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    lenders = counted.where(F.col("conv_id") % LENDER == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEADS - 1)).alias("lends"))
    shape = counted.select("conv_id", "n", h.alias("h"), base.alias("base")).join(lenders, "base", "left")
    lent = F.least("h", F.coalesce("lends", F.lit(0)))
    convs = materialize(shape.select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "conversations")
    turn = ["t1", "t2", "len"]
    own = placed.where(F.col("nth") > h).join(convs.select("conv_id", "h", "lent", "turns"), "conv_id").select("conv_id", (F.col("nth") - F.col("h") + F.col("lent")).alias("depth"), *turn, "turns")
    heads = placed.where((F.col("nth") < HEADS) & (F.col("conv_id") % LENDER == 0)).select(F.col("conv_id").alias("base"), F.col("nth").alias("depth"), *turn)
    borrowed = convs.join(heads, "base").where(F.col("depth") <= F.col("lent")).select("conv_id", "depth", *turn, "turns")
    return own.unionByName(borrowed), convs.select("conv_id", "turns")


def paths(turns: DataFrame) -> DataFrame:
    """turns as the nodes they lead to: (conv_id, depth, turns, len, k1..k4, up1..up4), up being the parent's sums."""
    a, b = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "depth", "t1")
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    pieces = [low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)]
    steps = turns.select("conv_id", "depth", "turns", "len", *(p.alias(f"s{i}") for i, p in enumerate(pieces, 1)))
    summed = running(steps, "conv_id", [F.col("depth")], ["s1", "s2", "s3", "s4"], "paths")
    return summed.select("conv_id", "depth", "turns", "len", *(F.col(f"upto_s{i}").alias(f"k{i}") for i in range(1, 5)), *((F.col(f"upto_s{i}") - F.col(f"s{i}")).alias(f"up{i}") for i in range(1, 5)))


def end_classes(ends: DataFrame) -> DataFrame:
    """Of (conv_id, node) rows, the classes by node: its least conv_id, their number and the SHA-256 of the ids in order."""
    node = ", ".join(f"{c} long" for c in NODE)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node among sorted rows, at most SEGMENT ids each."""
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            names = np.stack([batch.column(c).to_numpy() for c in NODE]) if len(ids) else np.zeros((5, 0), dtype=np.int64)
            cut = np.flatnonzero(np.concatenate(([True], (names[:, 1:] != names[:, :-1]).any(axis=0)))) if len(ids) else np.zeros(0, dtype=np.int64)
            starts = [s for a, b in zip(cut, [*cut[1:], len(ids)]) for s in range(a, b, SEGMENT)]
            stops = [*starts[1:], len(ids)]
            lists = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([*(pa.array(names[i][starts]) for i in range(5)), pa.array(ids[starts]), pa.array(np.subtract(stops, starts).astype(np.int64)), pa.array(lists, pa.string())], names=[*NODE, "conv_id", "m", "list"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each node of sorted segments; holds one digest at a time."""
        now, first, m, digest = None, None, 0, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                name = tuple(row[c] for c in NODE)
                if name != now:
                    if now is not None:
                        done.append((*now, first, m, digest.hexdigest()))
                    now, first, m, digest = name, row["conv_id"], 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row["list"].encode())
                m += row["m"]
            yield _rows(done)
        if now is not None:
            yield _rows([(*now, first, m, digest.hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*NODE, "conv_id", "m", "ends_sha256"])

    order = [*NODE, "conv_id"]
    cut = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(segments, f"{node}, conv_id long, m long, list string")
    return cut.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, f"{node}, conv_id long, m long, ends_sha256 string")


def merged(df: DataFrame, sums: list[str], least: list[str] = (), any_of: list[str] = ()) -> DataFrame:
    """One row for each node: partial tables of the tasks, then rounds that merge FAN tables into one."""
    kept = [*NODE, *sums, *least, *any_of]
    how = [(s, "sum") for s in sums] + [(s, "min") for s in least] + [(s, "max") for s in any_of]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, rows = TaskContext.get().partitionId(), [], 0

        def table() -> Iterator[pa.RecordBatch]:
            done = pa.Table.from_batches(waiting).group_by(NODE).aggregate(how)
            done = done.select([*NODE, *(f"{s}_{f}" for s, f in how)]).rename_columns(kept).append_column("part", pa.array(np.full(done.num_rows, part, dtype=np.int32)))
            yield from done.combine_chunks().to_batches()

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                yield from table()
                waiting, rows = [], 0
        if rows:
            yield from table()

    tables = df.select(*kept).mapInArrow(partial, ", ".join(f"{c} long" for c in kept) + ", part int")
    combine = [F.sum(s).alias(s) for s in sums] + [F.min(s).alias(s) for s in least] + [F.max(s).alias(s) for s in any_of]
    tables = tables.withColumn("part", F.pmod("part", F.lit(FAN**ROUNDS)).cast("int"))
    for _ in range(ROUNDS):
        tables = tables.groupBy(*NODE, F.shiftright("part", FAN.bit_length() - 1).alias("part")).agg(*combine)
    return tables.groupBy(*NODE).agg(*combine)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node, see op13_prefix_trie."""
    turns, convs = rebuilt(conversations)
    walks = materialize(paths(turns), "walks")
    last = walks.where(F.col("depth") == F.col("turns")).select("conv_id", *NODE)
    turnless = convs.where(F.col("turns") == 0).select("conv_id", *(F.lit(0).cast("long").alias(c) for c in NODE))
    classes = materialize(end_classes(last.unionByName(turnless)), "ends")

    walkers = materialize(walks.join(classes.select("conv_id", "m"), "conv_id"), "walkers")  # the least id of a class walks for it
    nodes = merged(walkers, ["m"], ["conv_id"], ["len", *PARENT]).withColumnRenamed("m", "n_convs")
    nodes = materialize(nodes, "nodes")
    above = nodes.groupBy((F.col("depth") - 1).alias("depth"), *(F.col(u).alias(k) for u, k in zip(PARENT, SUMS))).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(above, NODE, "left").na.fill(0, ["n_children"]), "children")

    # What belongs to a conversation, from its end up; a node's owner and depth name it as well as its sums do.
    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("len")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    weights = walkers.select("conv_id", *NODE).join(owned, ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    added = running(weights, "conv_id", [F.col("depth").desc()], ["saved", "leaf"], "rollup").select(*NODE, F.col("upto_saved").alias("saved_tokens"), F.col("upto_leaf").alias("n_leaves"))
    sums = merged(added, ["saved_tokens", "n_leaves"])

    parents = nodes.select(*(F.col(k).alias(u) for k, u in zip(SUMS, PARENT)), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    members, first = classes.agg(F.sum("m"), F.min("conv_id")).first()
    if members is None:
        top = []
    else:
        children, leaves, saved = nodes.agg(F.sum((F.col("depth") == 1).cast("long")), F.sum((F.col("n_children") == 0).cast("long")), F.sum((F.col("n_convs") - 1) * F.col("len"))).first()
        top = [(0, 0, 0, 0, 0, first, None, members, children or 0, leaves or 1, saved or 0)]
    figures = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    root = conversations.sparkSession.createDataFrame(top, ", ".join(f"{c} long" for c in [*NODE, *figures]))
    parent = F.when(F.col("depth") == 1, F.lit(first).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id")
    below = nodes.join(sums, NODE).join(parents, ["depth", *PARENT], "left").select(*NODE, *(parent if c == "parent_conv_id" else c for c in figures))
    out = below.unionByName(root).join(classes.select(*NODE, "ends_sha256"), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
