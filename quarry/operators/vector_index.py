"""Stored vectors in cells, searched exactly: what the triangle inequality rules out is not read.

Centres are fitted by k-means on a bounded sample (``SAMPLE`` rows by hash of
the id); every row lies in the cell of its nearest centre, with its distance to
it.  A cell's rows are at least |query - centre| - radius away, so after the
nearest cells have given k rows, only cells and rings that reach nearer than
the k-th of them are read.  Under the cosine metric all this holds of unit
vectors, whose Euclidean distance grows with the cosine distance.

Rows whose vector is null, of another width or too short to have a direction
lie in a cell of their own; the last of these are always read, as they have
distance 1 from everything.

``nearest_join`` answers many queries in the same way: a query goes to the
cells that it has to see, parts of cells meet blocks of queries, and each such
pair is one product of two small matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

from ..functions import vectors as V
from ..sources.snapshots import Snapshots
from . import retrieval
from .text_index import freshness

#: The layout of what is stored.
FORMAT = 2
#: Rows that the centres are fitted on, and cells at most: what comes to the driver.
SAMPLE, CELLS = 20_000, 2_048
ROUNDS = 12
#: Rows of each cell that a join's queries look at first, for how far they have to look at all.
SCOUTS = 8
#: Rows of a part of a cell, and queries of a block, that meet in one task.
PART, BLOCK = 4_096, 1_024
#: Norm below which a vector has no direction; room for rounding in bounds.
SHORT, ROOM = 1e-6, 1e-7
#: Cells of vectors without a direction, and of those that no query can be compared with.
FLAT, ODD = -1, -2


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """k-means from evenly spread rows of the sample; empty cells keep their centre."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of each row's nearest centre."""
    square = (centres**2).sum(axis=1)
    own = np.concatenate([np.argmin(square - 2 * (rows[i : i + 4096] @ centres.T), axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, dtype=int)])
    return own, np.linalg.norm(rows - centres[own], axis=1)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the right width as rows, which rows of the column they are)."""
    sizes = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
    whole = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    good = np.isfinite(flat).all(axis=1)
    return flat[good], whole[good]


def _scaled(rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows as they are compared, whether they have a direction)."""
    if metric != "cosine":
        return rows, np.ones(len(rows), dtype=bool)
    norms = np.linalg.norm(rows, axis=1)
    return rows / np.maximum(norms, SHORT)[:, None], norms >= SHORT


@dataclass
class VectorIndex:
    """A handle on one snapshot of the index below a path."""

    spark: SparkSession
    path: str
    version: int | None = None

    def __post_init__(self) -> None:
        self.log = Snapshots(self.spark, self.path)
        self.version = self.log.latest() if self.version is None else self.version
        self.manifest = self.log.manifest(self.version) if self.version is not None else {}
        if self.manifest.get("format") != FORMAT:  # another layout is built anew
            self.manifest = {}
        if self.manifest:
            rows = self.spark.read.parquet(f"{self.log.path}/{self.manifest['cells']}").orderBy("cell").collect()  # CELLS rows at most, and two
            self.cells = np.array([r["cell"] for r in rows], dtype=int)
            self.sizes, self.radius, self.least = (np.array([r[c] for r in rows], dtype=float) for c in ("n", "radius", "least"))
            self.centres = np.array([r["centre"] if r["centre"] else [np.nan] * self.manifest["dim"] for r in rows], dtype=float).reshape(len(rows), self.manifest["dim"])

    def sync(self, df: DataFrame, *, id: str, vector: str, dim: int, metric: str = "cosine", keep: tuple[str, ...] = ()) -> VectorIndex:
        """The handle of a snapshot of df's rows as they are now; built anew if the files behind them changed."""
        token = freshness(df)
        if token is not None and token == self.manifest.get("token"):
            return self
        rows = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"), *keep)
        fitting = rows.where(V.width_is(F.col("vector"), dim))
        n = fitting.count()
        sample, _ = _matrix(pa.array([r[0] for r in fitting.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()], pa.list_(pa.float64())), dim)
        sample, pointed = _scaled(sample, metric)
        sample = sample[pointed]
        centres = fit_centres(sample, max(1, min(CELLS, int(n**0.5)))) if len(sample) else np.zeros((1, dim))
        names = [f.name for f in rows.schema.fields]

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, where = _matrix(batch.column("vector"), dim)
                cell, away = np.full(batch.num_rows, ODD), np.zeros(batch.num_rows)
                found, pointed = _scaled(found, metric)
                own, distance = _nearest(found, centres)
                cell[where], away[where] = np.where(pointed, own, FLAT), np.where(pointed, distance, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(cell.astype(np.int32))], names=[*names, "away", "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        made = rows.mapInArrow(placed, f"{kinds}, away double, cell int").hint("rebalance", "cell").sortWithinPartitions("cell", "away")
        folder = self.log.put(made, "rows", ("cell",))
        held = self.spark.read.parquet(f"{self.log.path}/{folder}").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min("away").alias("least"))
        points = self.spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
        cells = self.log.put(held.join(F.broadcast(points), "cell", "left").coalesce(1), "cells")  # a row for each centre
        nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))
        some = self.spark.read.parquet(f"{self.log.path}/{folder}").where(F.col("cell") >= 0).select("id", "vector", nth.alias("nth")).where(F.col("nth") <= SCOUTS)
        scouts = self.log.put(some.select("id", "vector").coalesce(1), "scouts")  # SCOUTS rows a cell
        manifest = {"format": FORMAT, "token": token, "rows": folder, "cells": cells, "scouts": scouts, "dim": dim, "metric": metric, "schema": made.schema.jsonValue()}
        return VectorIndex(self.spark, self.path, self.log.commit(manifest, self.version))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.manifest["schema"])).parquet(f"{self.log.path}/{self.manifest['rows']}")

    def _reach(self, distances: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have, from distances to the centres; rows by queries."""
        low = np.maximum(0.0, np.maximum(distances - self.radius, self.least - distances))
        low[..., self.cells == FLAT] = 0.0
        low[..., self.cells == ODD] = np.inf
        return low

    def search(self, query: list[float], k: int = retrieval.POOL, *, where: Column | None = None, id: str = "chunk_id") -> DataFrame:
        """(id, distance, rank) of the k nearest, exactly; where may name columns that the index keeps."""
        return self.search_with_report(query, k, where=where, id=id)[0]

    def search_with_report(self, query: list[float], k: int = retrieval.POOL, *, where: Column | None = None, id: str = "chunk_id") -> tuple[DataFrame, dict]:
        """The same, with cells and rows that there are and that were read."""
        k, metric = max(1, min(int(k), retrieval.HIT_ROWS)), self.manifest["metric"]
        scaled, pointed = _scaled(np.array([query], dtype=float), metric)
        rows = self.rows() if where is None else self.rows().where(where)
        away = retrieval.distance_of(query, metric)
        scored = lambda df: df.select(F.col("id").alias(id), away(F.col("vector")).alias("distance")).where(F.col("distance").isNotNull())
        report = {"cells": len(self.cells), "rows": int(self.sizes.sum())}
        ask = self.cells != ODD
        if pointed[0]:
            centre = np.linalg.norm(self.centres - scaled[0], axis=1)
            low = self._reach(centre)
            order = np.argsort(low, kind="stable")
            taken, kth = k, np.inf
            while not np.isfinite(kth):
                some = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), taken)) + 1]
                first = scored(rows.where(F.col("cell").isin(self.cells[some].tolist()))).orderBy("distance").limit(k).collect()
                if len(first) >= k:
                    kth = first[-1]["distance"]
                elif len(some) == len(order):
                    break
                taken *= 8
            limit = (np.sqrt(max(0.0, 2 * kth)) if metric == "cosine" else kth) + ROOM
            ask &= low <= limit
            if np.isfinite(limit):
                ring = self.spark.createDataFrame([(int(c), float(d - limit), float(d + limit)) if c >= 0 else (int(c), -1.0, 1.0) for c, d in zip(self.cells[ask], centre[ask])], "cell int, inner double, outer double")
                rows = rows.where(F.col("cell").isin(self.cells[ask].tolist())).join(F.broadcast(ring), "cell").where("away >= inner AND away <= outer")  # a row a cell
        report |= {"cells_read": int(ask.sum()), "rows_read": int(self.sizes[ask].sum())}
        top = scored(rows.where(F.col("cell").isin(self.cells[ask].tolist()))).orderBy("distance", id).limit(k)
        return retrieval.ranked(top, [F.col("distance"), F.col(id)]), report

    def nearest_join(self, queries: DataFrame, k: int, *, other: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
        """(query, id, similarity, place, kept columns) of each query's k nearest by cosine; queries has (query, vector).

        With other, a row of the query's own id is no answer.  Queries without a
        direction have similarity 0 with every row and are left out.
        """
        if self.manifest["metric"] != "cosine":
            raise ValueError("the index is not of unit vectors")
        spark, dim = self.spark, self.manifest["dim"]
        parts = np.maximum(1, -(-self.sizes // PART)).astype(int)
        in_part = spark.createDataFrame([(int(c), int(p)) for c, p in zip(self.cells, parts)], "cell int, parts int")
        rows = self.rows().join(F.broadcast(in_part), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row a cell
        kind = queries.schema["query"].dataType.simpleString()
        scouts = self.spark.read.parquet(f"{self.log.path}/{self.manifest['scouts']}").collect()  # SCOUTS rows a cell at most
        names = np.array([r["id"] for r in scouts], dtype=object)
        known, _ = _scaled(np.array([r["vector"] for r in scouts], dtype=float).reshape(-1, dim), "cosine")
        cells, centres, radius, least = self.cells, self.centres, self.radius, self.least

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """(query, vector, cell) of the cells that hold rows as near as the query's k-th scout, or could."""
            for whole in batches:
                for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                    found, at = _matrix(batch.column("vector"), dim)
                    unit, pointed = _scaled(found, "cosine")
                    unit, at = unit[pointed], at[pointed]
                    near = unit @ known.T
                    if other and len(names):
                        own = np.array(batch.column("query").to_pylist(), dtype=object)[at]
                        near[own[:, None] == names[None, :]] = -np.inf
                    edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] >= k else np.full(len(unit), -np.inf)
                    limit = np.sqrt(np.maximum(0.0, 2 - 2 * edge))
                    apart = np.sqrt(np.maximum(0.0, 1 + (centres**2).sum(axis=1) - 2 * unit @ centres.T))
                    low = np.maximum(0.0, np.maximum(apart - radius, least - apart))
                    low[:, cells == FLAT], low[:, cells == ODD] = 0.0, np.nan
                    q, c = np.nonzero(low <= limit[:, None] + ROOM)
                    picked = pa.array(at[q])
                    yield pa.RecordBatch.from_arrays([batch.column("query").take(picked), batch.column("vector").take(picked), pa.array(cells[c].astype(np.int32))], names=["query", "vector", "cell"])

        vectors = queries.schema["vector"].dataType.simpleString()
        answer = StructType.fromDDL(f"query {kind}, id {rows.schema['id'].dataType.simpleString()}, qv {vectors}, rv {rows.schema['vector'].dataType.simpleString()}, {''.join(f'`{c}` {rows.schema[c].dataType.simpleString()}, ' for c in keep)}near double")

        def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            """Each query's k nearest of a part of a cell, and what ties with the k-th but for rounding."""
            if asked.empty or held.empty:
                return pd.DataFrame({f.name: [] for f in answer.fields})
            a, _ = _scaled(np.stack(asked["vector"].to_numpy()).astype(float), "cosine")
            b, ok = _scaled(np.stack(held["vector"].to_numpy()).astype(float), "cosine")
            near = np.where(ok[None, :], a @ b.T, 0.0)
            if other:
                near[asked["query"].to_numpy()[:, None] == held["id"].to_numpy()[None, :]] = -np.inf
            n = min(k, near.shape[1])
            edge = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
            q, r = np.nonzero((near >= edge[:, None] - ROOM) & np.isfinite(near))
            out = {"query": asked["query"].to_numpy()[q], "id": held["id"].to_numpy()[r], "qv": asked["vector"].to_numpy()[q], "rv": held["vector"].to_numpy()[r], **{c: held[c].to_numpy()[r] for c in keep}, "near": near[q, r]}
            return pd.DataFrame(out)

        def met(asked: DataFrame) -> DataFrame:
            """asked (query, vector, cell) against the parts of their cells, in blocks of queries."""
            blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row a cell
            held = rows.select("id", "vector", *keep, "cell", "part").join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            spread = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
            spread = spread.join(F.broadcast(in_part), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            at = ["cell", "part", "block"]
            return spread.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(meet, answer)

        shape = f"query {kind}, vector {vectors}, cell int"
        found = met(queries.select("query", "vector").mapInArrow(routed, shape))
        exact = found.select("query", "id", V.cosine(F.col("qv"), F.col("rv")).alias("similarity"), *keep)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return exact.withColumn("place", place).where(F.col("place") <= k)


def open_vectors(df: DataFrame, path: str, *, id: str, vector: str, dim: int, metric: str = "cosine", keep: tuple[str, ...] = ()) -> VectorIndex:
    """The index below path, brought up to df's rows."""
    return VectorIndex(df.sparkSession, path).sync(df, id=id, vector=vector, dim=dim, metric=metric, keep=keep)
