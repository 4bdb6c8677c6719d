"""Nearest, backward and forward as-of joins without a pairwise join.

Both sides are merged per key in order of time; running first/last values give
each left row its neighbours, so work and memory follow the number of rows,
not of pairs.  All rows of one key are sorted in one task, which spills what it
cannot hold; a key is a video here, so its rows are bounded by its length.  With
``spread`` the merged rows lie in ranges of (key, time) instead and what ranges
leave open is carried on (see ``scan``), for keys that may hold any share of
all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def _sides(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_id: str, spread: bool = False) -> DataFrame:
    """left with _prev and _next: the last right row at or before its time, the first at or after it, as struct<time, id>."""
    point = F.struct(F.col(right_time).alias("time"), F.col(right_id).alias("id"))
    kind = right.select(F.col(key), F.col(right_time)).schema
    row = F.struct(*[F.col(c) for c in left.columns])
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    some = F.lit(None).cast(right.select(point.alias("p")).schema["p"].dataType)
    both = left.select(F.col(key).alias("_k"), F.col(left_time).cast(kind[right_time].dataType).alias("_t"), row.alias("_l"), some.alias("_r"))
    both = both.unionByName(right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), none.alias("_l"), point.alias("_r")))
    isright = F.col("_r").isNotNull()
    if spread:
        side = F.when(isright, 0).otherwise(1)
        both = scan.scanned(both, "_k", [F.col("_t"), side, F.col("_r.id").desc()], last=("_r",), name="up").withColumnRenamed("last__r", "_prev")
        both = scan.scanned(both, "_k", [F.col("_t").desc(), side, F.col("_r.id").desc()], last=("_r",), name="down").withColumnRenamed("last__r", "_next")
        return both.where(F.col("_l").isNotNull()).select("_l.*", "_prev", "_next")
    # Right rows of a left row's own time count on both sides: first them, then it, going either way.
    up = Window.partitionBy("_k").orderBy("_t", F.when(isright, 0).otherwise(1), F.col("_r.id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_k").orderBy(F.col("_t").desc(), F.when(isright, 0).otherwise(1), F.col("_r.id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_prev", F.last("_r", ignorenulls=True).over(up)).withColumn("_next", F.last("_r", ignorenulls=True).over(down))
    return both.where(F.col("_l").isNotNull()).select("_l.*", "_prev", "_next")


def nearest(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, right_id: str, tie: str = "later", spread: bool = False) -> DataFrame:
    """left with match_id and match_time, the right row of least distance in time; tie is "later" or "earlier".

    Of right rows at one time the least id counts.
    """
    rows = _sides(left, right, key, left_time, right_time, right_id, spread)
    t = F.col(left_time)
    back, ahead = t - F.col("_prev.time"), F.col("_next.time") - t
    take_next = (ahead <= back) if tie == "later" else (ahead < back)
    best = F.when(F.col("_prev").isNull(), F.col("_next")).when(F.col("_next").isNull(), F.col("_prev")).when(take_next, F.col("_next")).otherwise(F.col("_prev"))
    return rows.withColumn("_m", best).select(*left.columns, F.col("_m.id").alias("match_id"), F.col("_m.time").alias("match_time"))


def backward(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, right_id: str, clamp: bool = True, spread: bool = False) -> DataFrame:
    """The last right row at or before; with clamp the first after where there is none."""
    rows = _sides(left, right, key, left_time, right_time, right_id, spread)
    best = F.coalesce("_prev", "_next") if clamp else F.col("_prev")
    return rows.withColumn("_m", best).select(*left.columns, F.col("_m.id").alias("match_id"), F.col("_m.time").alias("match_time"))


def forward(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, right_id: str, clamp: bool = True, spread: bool = False) -> DataFrame:
    """The first right row at or after; with clamp the last before where there is none."""
    rows = _sides(left, right, key, left_time, right_time, right_id, spread)
    best = F.coalesce("_next", "_prev") if clamp else F.col("_next")
    return rows.withColumn("_m", best).select(*left.columns, F.col("_m.id").alias("match_id"), F.col("_m.time").alias("match_time"))


def frames_for_chunks(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """chunks with frame_ids: the frame nearest the chunk's midpoint, and the one nearest ten seconds on
    unless the video is under half a minute or the frame is the same; none for headers and descriptions."""
    mid = F.when(F.col("chunk_end_ms") > F.col("chunk_start_ms"), F.expr("(chunk_start_ms + chunk_end_ms) div 2")).otherwise(F.col("chunk_start_ms"))
    apt = ~F.col("chunk_type").isin("header", "description") & F.col("chunk_start_ms").isNotNull()
    rows = chunks.withColumn("_mid", F.when(apt, mid)).withColumn("_on", F.col("_mid") + 10_000)
    one = nearest(rows, frames, key="video_id", left_time="_mid", right_time="frame_ms", right_id="frame_id").withColumnRenamed("match_id", "_a").drop("match_time")
    two = nearest(one, frames, key="video_id", left_time="_on", right_time="frame_ms", right_id="frame_id").withColumnRenamed("match_id", "_b").drop("match_time")
    second = F.col("_b").isNotNull() & (F.col("_a") != F.col("_b")) & ~F.coalesce(F.col("duration_ms") < 30_000, F.lit(False))
    ids = F.when(F.col("_mid").isNull() | F.col("_a").isNull(), F.array().cast("array<bigint>")).when(second, F.array("_a", "_b")).otherwise(F.array("_a"))
    return two.withColumn("frame_ids", ids).drop("_mid", "_on", "_a", "_b")


def frames_for_times(wanted: DataFrame, frames: DataFrame, cap: int) -> DataFrame:
    """Frames nearest the asked times (video_id, place, at_ms): distinct, the first cap in order of asking, then by time."""
    cap = max(1, min(int(cap), 12))
    near = nearest(wanted, frames, key="video_id", left_time="at_ms", right_time="frame_ms", right_id="frame_id", tie="earlier").where(F.col("match_id").isNotNull())
    first = near.groupBy("video_id", F.col("match_id").alias("frame_id"), F.col("match_time").alias("frame_ms")).agg(F.min("place").alias("place"))
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy("video_id").orderBy("place"))).where(F.col("_n") <= cap)
    return kept.select("video_id", "frame_id", "frame_ms")


def even_sample(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most cap rows of each group, evenly spaced: from the first to the last: places round(i * (n - 1) / (cap - 1)), halves to the even place."""
    w = Window.partitionBy(*by)
    n = F.col("_n")
    numbered = rows.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    picks = F.when(F.lit(cap) <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(cap - 1, 0))), lambda i: F.bround(i * (n - 1) / F.lit(max(cap - 1, 1))).cast("long")))
    return numbered.where((n <= cap) | F.array_contains(picks, F.col("_i").cast("long"))).drop("_n", "_i")


def locate_frames(targets: DataFrame, segments: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, target_id, segment, sample) of targets (video_id, target_id, pts).

    segments has (video_id, segment, pts), samples (video_id, segment, sample,
    pts).  A target lies in the last segment that begins at or before it, else
    in the first; there the first sample in order of decoding that is shown at
    or after it counts, else the last one, and none where the segment has none.
    """
    starts = segments.groupBy("video_id", "pts").agg(F.max("segment").alias("segment"))
    placed = backward(targets.select("video_id", "target_id", F.col("pts").alias("at")), starts.select("video_id", F.col("pts").alias("start"), "segment"), key="video_id", left_time="at", right_time="start", right_id="segment")
    rows = placed.where(F.col("match_id").isNotNull()).select("video_id", F.col("match_id").alias("segment"), F.col("at").alias("pts"), "target_id", F.lit(None).cast(samples.schema["sample"].dataType).alias("sample"), F.lit(True).alias("_asked"))
    kept = samples.join(rows.select("video_id", "segment").distinct(), ["video_id", "segment"], "left_semi")
    both = rows.unionByName(kept.select("video_id", "segment", "pts", F.lit(None).cast(targets.schema["target_id"].dataType).alias("target_id"), "sample", F.lit(False).alias("_asked")))
    own = Window.partitionBy("video_id", "segment")
    ahead = F.min("sample").over(own.orderBy(F.col("pts").desc(), "_asked").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_s", F.coalesce(ahead, F.max("sample").over(own))).where("_asked").select("video_id", "target_id", "segment", F.col("_s").alias("sample"))


def segment_jobs(located: DataFrame) -> DataFrame:
    """(video_id, segment, targets, last_sample): what to load of each segment; targets are those a user asked of it."""
    point = F.struct("target_id", "sample")
    return located.groupBy("video_id", "segment").agg(F.array_sort(F.collect_list(point)).alias("targets"), F.max("sample").alias("last_sample"))
