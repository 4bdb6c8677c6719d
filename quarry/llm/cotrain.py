"""Quality classifier by co-training two views of a document.

The content view is a logistic model on hashed words and text statistics; the
metadata view is one on source, language and length.  Each round both models
score every document without a label, in one pass over features that are
written once, and the ``SHARE`` of them that a view is surest of are its
pseudo-labels; they join the training rows of the other view.  Held-out
labelled rows calibrate each view and weigh them into one probability, which
then scores every document in one pass without a shuffle.

The models are fitted on the driver, on bounded samples of rows that have a
label: at most ``FIT_ROWS`` labelled ones in order of a hash of doc_id, and of
each view's pseudo-labels of a kind at most ``TAKE_ROWS`` a round, dealt from
all sources in turn, so that a source of a third of all rows does not fill them.

Defined results: a null or empty text has no words, a null source or language
is a value of its own, so every row gets a score; null ids and repeated rows
pass row by row; an empty table gives an empty result; without labels of both
kinds every score is 0.5 and every row is kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boost import held_logistic, platt
from .bpe import RangeHash, mix
from .common import documents, forget, map_arrow, materialize, text_buffer, words_of
from .rules import COUNTS, RATIOS, _statistics, labelled_sample

FIT_ROWS, TAKE_ROWS = 6_000, 600
WORD_BUCKETS, META_BUCKETS = 4_096, 1_024
ROUNDS, SHARE = 4, 0.05
#: A view that is less sure than this teaches nothing; probabilities are counted in so many bins.
SURE, BINS = 0.9, 1_000
HELD_OUT = 0.25
THRESHOLD = 0.5
COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")


@dataclass
class Sparse:
    """Rows of (index, value) pairs, end to end."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=self.rows)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row] * self.value, minlength=size)

    def take(self, rows: np.ndarray) -> Sparse:
        count = np.bincount(self.row, minlength=self.rows)
        begin = np.cumsum(count) - count
        n = count[rows]
        at = np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return Sparse(np.repeat(np.arange(len(rows)), n), self.index[at], self.value[at], len(rows))

    def then(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate([self.row, other.row + self.rows]), np.concatenate([self.index, other.index]), np.concatenate([self.value, other.value]), self.rows + other.rows)


def _bucket(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={'null' if value is None else 'is ' + str(value)}".encode()) % META_BUCKETS


class Views:
    """Features of a batch of COLUMNS."""

    width = WORD_BUCKETS + len(RATIOS) + 1

    def __init__(self) -> None:
        self._hash, self._count = RangeHash(), _statistics()

    def content(self, batch: pa.RecordBatch) -> Sparse:
        """Share of each hashed word, then ratios, squashed to 0..1, then one."""
        buf, start, end = text_buffer(batch.column(1))
        rows = len(start)
        ws, we, row = words_of(buf, start, end)
        self._hash.load(buf)
        bucket = (mix(self._hash.of(ws, we)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        cell, times = np.unique(row * WORD_BUCKETS + bucket, return_counts=True)
        n = np.maximum(np.bincount(row, minlength=rows), 1)
        counts = self._count(batch.select(["doc_id", "text"]))
        own = {c: counts.column(i + 1).to_numpy().astype(float) for i, c in enumerate(COUNTS)}
        dense = [np.tanh(own[top] / (np.maximum(own[bottom], 1) if bottom else 1000.0)) for _, top, bottom in RATIOS]
        dense.append(np.ones(rows))
        at = np.arange(rows)
        r = np.concatenate([cell // WORD_BUCKETS, *[at] * len(dense)])
        i = np.concatenate([cell % WORD_BUCKETS, *(np.full(rows, WORD_BUCKETS + k) for k in range(len(dense)))])
        v = np.concatenate([times / n[cell // WORD_BUCKETS], *dense])
        order = np.argsort(r, kind="stable")
        return Sparse(r[order], i[order], v[order], rows)

    def metadata(self, batch: pa.RecordBatch) -> Sparse:
        source, lang, chars = (batch.column(i).to_pylist() for i in (2, 3, 4))
        index = [[_bucket("source", s), _bucket("lang", x), _bucket("both", (s, x)), _bucket("size", None if c is None else int(max(c, 0)).bit_length()), META_BUCKETS] for s, x, c in zip(source, lang, chars)]
        rows = len(index)
        return Sparse(np.repeat(np.arange(rows), 5), np.array(index, dtype=np.int64).reshape(-1), np.ones(5 * rows), rows)


def logistic(x: Sparse, y: np.ndarray, size: int, *, penalty: float, steps: int = 150) -> np.ndarray:
    """Weights of a logistic fit by Nesterov's steps, each feature scaled by its own curvature."""
    scale = 1 / np.sqrt(np.bincount(x.index, weights=x.value**2, minlength=size) / max(1, x.rows) + 1e-4)
    w, v = np.zeros(size), np.zeros(size)
    rate = 1.0
    for k in range(steps):
        ahead = w + k / (k + 3) * v
        g = x.back(1 / (1 + np.exp(-np.clip(x.dot(ahead), -40, 40))) - y, size) / max(1, x.rows) + penalty * ahead / scale**2 / max(1, x.rows)
        new = ahead - rate * scale**2 * g / 4
        w, v = new, new - w
    return w


@dataclass
class CoTrained:
    content: np.ndarray
    metadata: np.ndarray
    #: (slope, offset) of each view's logit, and (weights, offset) of both.
    calibration: tuple[tuple[float, float], tuple[float, float]]
    joint: tuple[float, float, float]


def _joint(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of two calibrated logits, none below 0, and an offset: a logistic fit lightly held to the content view."""
    w = held_logistic(np.stack([a, b, np.ones(len(a))], axis=1), y, np.array([1.0, 0.0, 0.0]))
    return float(max(w[0], 0.0)), float(max(w[1], 0.0)), float(w[2])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: What co-training asks each round: given each view's weights, each view's (slope, offset) and the share of good rows,
#: for each view the rows that it is sure of, as both views see them, with their labels.
Teach = Callable[[list[np.ndarray], list[tuple[float, float]], float], list[tuple[tuple[Sparse, Sparse], np.ndarray]]]


def co_train(content: Sparse, metadata: Sparse, y: np.ndarray, teach: Teach, *, rounds: int = ROUNDS, seed: int = 3) -> CoTrained | None:
    """Both views of labelled rows, whose label y is 0 or 1, and what teaches them more."""
    part = np.random.default_rng(seed).random(len(y))
    # Some rows say how sure a view may be of its pseudo-labels, others calibrate and weigh the views at the end.
    fit, gate, held = np.flatnonzero(part >= HELD_OUT), np.flatnonzero(part < HELD_OUT / 2), np.flatnonzero((part >= HELD_OUT / 2) & (part < HELD_OUT))
    if any(len(np.unique(y[rows])) < 2 for rows in (fit, gate, held)):
        return None
    views = [(content, Views.width, 0.3), (metadata, META_BUCKETS + 1, 1.0)]
    known = [(x.take(fit), y[fit].astype(float)) for x, _, _ in views]
    good = float(y[fit].mean())
    for turn in range(rounds + 1):
        weights = [logistic(x, label, size, penalty=penalty) for (_, size, penalty), (x, label) in zip(views, known)]
        if turn == rounds:
            break
        fits = [platt(x.dot(w)[gate], y[gate].astype(float)) for (x, _, _), w in zip(views, weights)]
        for me, (seen, label) in enumerate(teach(weights, fits, good)):
            if len(label):
                x, old = known[1 - me]
                known[1 - me] = x.then(seen[1 - me]), np.concatenate([old, label])
    logits = [x.dot(w)[held] for (x, _, _), w in zip(views, weights)]
    truth = y[held].astype(float)
    fits = [platt(s, truth) for s in logits]
    a, b = (k * s + c for s, (k, c) in zip(logits, fits))
    return CoTrained(weights[0], weights[1], (fits[0], fits[1]), _joint(a, b, truth))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, source, ci, cv, mi) of every row: both views' features, and a hash that equal rows share."""
    columns = [F.col(c).cast(t).alias(c) for c, t in zip(COLUMNS, ("bigint", "string", "string", "string", "bigint"))]
    made: list[Views] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Views())
        own = batch.select(list(COLUMNS))
        c, m = made[0].content(own), made[0].metadata(own)

        def lists(values: np.ndarray, x: Sparse, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(x.row, np.arange(x.rows + 1)), pa.int32()), pa.array(values, kind))

        return pa.RecordBatch.from_arrays([own.column(0), batch.column(5), own.column(2), lists(c.index, c, pa.int16()), lists(c.value, c, pa.float32()), lists(m.index, m, pa.int16())], ["doc_id", "mark", "source", "ci", "cv", "mi"])

    return map_arrow(docs.select(*columns).withColumn("mark", F.xxhash64(*COLUMNS)), run, "doc_id bigint, mark bigint, source string, ci array<smallint>, cv array<float>, mi array<smallint>")


def _views(ci: pa.Array, cv: pa.Array, mi: pa.Array) -> tuple[Sparse, Sparse]:
    """Both views of rows of features."""

    def sparse(index: pa.Array, value: pa.Array | None) -> Sparse:
        n = np.diff(index.offsets.to_numpy())
        i = index.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        v = value.flatten().to_numpy(zero_copy_only=False).astype(float) if value is not None else np.ones(len(i))
        return Sparse(np.repeat(np.arange(len(n)), n), i, v, len(n))

    return sparse(ci, cv), sparse(mi, None)


def _fetched(rows: DataFrame, *order: str) -> tuple[tuple[Sparse, Sparse], pa.Table]:
    """Both views of a bounded number of rows of features, in that order, and the rows."""
    table = rows.toArrow().sort_by([(c, "ascending") for c in order])
    ci, cv, mi = (table[c].combine_chunks() for c in ("ci", "cv", "mi"))
    return _views(*(x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ci, cv, mi))), table


def sure(scored: DataFrame, good: float, share: float, take_rows: int) -> DataFrame:
    """(view, label, mark) of pseudo-labels, for the probabilities p0 and p1 of rows (mark, source, p0, p1) without a label.

    A view takes the share of all rows that it is surest of, ``good`` of them
    as good; of what lies in its bins that many are taken, and at most take_rows,
    from all sources in turn, in order of mark.  Equal rows are taken once.
    """
    bin_of = lambda p: F.least(F.floor(p * BINS), F.lit(BINS - 1)).cast("int")
    long = scored.select("mark", "source", F.inline(F.array(*(F.struct(F.lit(v).alias("view"), F.col(f"p{v}").alias("p")) for v in (0, 1))))).withColumn("bin", bin_of(F.col("p")))
    counts = np.zeros((2, BINS), dtype=np.int64)
    for r in long.groupBy("view", "bin").count().collect():  # bounded: two views' bins
        counts[r["view"], r["bin"]] = r["count"]
    many = max(1, int(share * counts[0].sum()))
    low, high = max(1, int(many * (1 - good))), max(1, int(many * good))
    label = F.lit(None).cast("int")
    for v in (0, 1):
        last = min(int(np.searchsorted(np.cumsum(counts[v]), low)), BINS - 1)
        first = BINS - 1 - min(int(np.searchsorted(np.cumsum(counts[v][::-1]), high)), BINS - 1)
        bad = (F.col("bin") <= last) & (F.col("p") < 1 - SURE)
        label = F.when((F.col("view") == v) & bad, 0).when((F.col("view") == v) & (F.col("bin") >= first) & (F.col("p") > SURE), 1).otherwise(label)
    picked = long.withColumn("label", label).where("label is not null").groupBy("view", "label", "mark").agg(F.min("source").alias("source"))
    place = F.row_number().over(Window.partitionBy("view", "label", "source").orderBy("mark"))
    picked = picked.withColumn("place", place).where(F.col("place") <= take_rows)
    turn = F.row_number().over(Window.partitionBy("view", "label").orderBy("place", "mark"))
    return picked.withColumn("turn", turn).where(F.col("turn") <= F.when(F.col("label") == 1, high).otherwise(low)).where(F.col("turn") <= take_rows).select("view", "label", "mark")


def fit_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, take_rows: int = TAKE_ROWS, share: float = SHARE, rounds: int = ROUNDS, seen: list | None = None) -> CoTrained | None:
    """A model of quality = 1 from a bounded sample of labelled rows and pseudo-labels over all others; seen gets each round's (view, label, mark)."""
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    table = materialize(features(docs), "features")
    (content, metadata), rows = _fetched(labelled_sample(table, labels.select("doc_id", "quality"), ["quality"], fit_rows), "doc_id", "quality", "mark")
    taken: set[int] = set()

    def teach(weights: list[np.ndarray], fits: list[tuple[float, float]], good: float) -> list[tuple[tuple[Sparse, Sparse], np.ndarray]]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = [_sigmoid(k * x.dot(w) + c) for x, w, (k, c) in zip(_views(*batch.columns[3:]), weights, fits)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, p)], ["doc_id", "mark", "source", "p0", "p1"])

        scored = map_arrow(table, run, "doc_id bigint, mark bigint, source string, p0 double, p1 double")
        if taken:
            old = table.sparkSession.createDataFrame([(m,) for m in sorted(taken)], "mark bigint")  # bounded by take_rows and rounds
            scored = scored.join(F.broadcast(old), "mark", "left_anti")
        # Rows without an id have no label and need not meet the labels.
        named = scored.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti")
        scored = materialize(named.unionByName(scored.where(F.col("doc_id").isNull())).drop("doc_id"), "scored")
        picked = [tuple(r) for r in sure(scored, good, share, take_rows).collect()]  # bounded by take_rows
        forget(scored)
        taken.update(m for _, _, m in picked)
        if seen is not None:
            seen.append(sorted(picked))
        marks = table.sparkSession.createDataFrame([(m,) for m in sorted({m for _, _, m in picked})], "mark bigint")
        both, found = _fetched(table.join(F.broadcast(marks), "mark").dropDuplicates(["mark"]), "mark")
        at = {m: i for i, m in enumerate(found["mark"].to_pylist())}
        out = []
        for me in (0, 1):
            own = sorted((at[m], label) for view, label, m in picked if view == me)
            place = np.array([i for i, _ in own], dtype=np.int64)
            out.append(((both[0].take(place), both[1].take(place)), np.array([label for _, label in own], dtype=float)))
        return out

    model = co_train(content, metadata, rows["quality"].to_numpy(), teach, rounds=rounds)
    forget(table)
    return model


def score(docs: DataFrame, model: CoTrained | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, content_score, metadata_score, score and kept of every row of docs."""
    columns = [F.col(c).cast(t).alias(c) for c, t in zip(COLUMNS, ("bigint", "string", "string", "string", "bigint"))]
    schema = "doc_id bigint, content_score double, metadata_score double, score double, kept boolean"
    if model is None:
        half = F.lit(0.5)
        return docs.select(columns[0], half.alias("content_score"), half.alias("metadata_score"), half.alias("score"), F.lit(True).alias("kept"))
    made: list[Views] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Views())
        (k0, c0), (k1, c1) = model.calibration
        a = k0 * made[0].content(batch).dot(model.content) + c0
        b = k1 * made[0].metadata(batch).dot(model.metadata) + c1
        p = _sigmoid(model.joint[0] * a + model.joint[1] * b + model.joint[2])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in (_sigmoid(a), _sigmoid(b), p, p >= threshold))], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return map_arrow(docs.select(*columns), run, schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
