"""Keeping an index right: deltas, orphans, stale rows, replacement, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_TYPES = ("header", "description", "body", "frame_text")


def missing(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows of left without a partner: new chunks without a vector, vectors without a chunk, indexed ids that are not on disk."""
    other = right.select(F.col(right_key or key).alias("_k"))
    return left.join(other, F.col(key) == F.col("_k"), "left_anti")


def stale(found: DataFrame, indexed: DataFrame, *, key: str, changed: str, done: str) -> DataFrame:
    """found rows that are not indexed, or changed after they were; compare with the index as it was before this run."""
    old = indexed.select(F.col(key).alias("_k"), F.col(done).alias("_done"))
    rows = found.join(old, F.col(key) == F.col("_k"), "left")
    return rows.where(F.col("_done").isNull() | (F.col(changed) > F.col("_done"))).drop("_k", "_done")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with their keys."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").select(*base.columns).unionByName(changes)


def replace_by(base: DataFrame, changes: DataFrame, group: str) -> DataFrame:
    """All rows of each group in changes in place of all of the group's rows in base."""
    return upsert(base, changes, [group])


def cascade_delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "video_id") -> dict[str, DataFrame]:
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti").select(*df.columns) for name, df in tables.items()}


def purge_other_models(df: DataFrame, current: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the current model, a row with the number purged)."""
    return df.where(F.col("model_version") == current), df.where(F.col("model_version") != current).agg(F.count("*").alias("purged"))


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def migration_scope(chunks: DataFrame, videos: DataFrame, active: str) -> DataFrame:
    """Videos and chunks of other models; chunks without a video do not count."""
    rows = chunks.join(videos.select("video_id"), "video_id").where(F.col("model_version") != active)
    return rows.agg(F.countDistinct("video_id").alias("videos"), F.count("*").alias("chunks"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out: DataFrame | None = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionAll(row)
    if out is None:
        raise ValueError("no table")
    return out


def index_state(videos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each video with its number of chunks and the least of their model versions."""
    own = chunks.groupBy("video_id").agg(F.count("*").alias("chunk_count"), F.min("model_version").alias("model_version"))
    return videos.join(own, "video_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def change_probe(df: DataFrame, id: str, *content: str) -> DataFrame:
    """(max_id, n, digest): differs whenever rows came, went or changed."""
    mark = F.xxhash64(id, *content)
    return df.agg(F.coalesce(F.max(id), F.lit(0)).alias("max_id"), F.count("*").alias("n"), F.coalesce(F.bit_xor(mark), F.lit(0).cast("long")).alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether two probes differ; each is one row."""
    return [tuple(r) for r in before.collect()] != [tuple(r) for r in after.collect()]


def valid_chunks(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks of a known type with a vector of the right width."""
    return chunks.where(F.col("chunk_type").isin(*CHUNK_TYPES) & (F.size("embedding") == dim))


def distinct_contents(df: DataFrame, content: str, by: list[str]) -> DataFrame:
    """Different contents of each group, by digest."""
    return df.groupBy(*by).agg(F.countDistinct(F.sha2(F.col(content).cast("binary"), 256)).alias("n_distinct"), F.count("*").alias("n"))


def summary(actions: DataFrame) -> DataFrame:
    """Counters of a run from (video_id, action, chunks): videos, chunks, deleted, kept, dropped, failures."""
    count = lambda a: F.coalesce(F.sum((F.col("action") == a).cast("long")), F.lit(0)).alias(a)
    return actions.agg(F.coalesce(F.sum((F.col("action") == "indexed").cast("long")), F.lit(0)).alias("videos"), F.coalesce(F.sum(F.when(F.col("action") == "indexed", F.col("chunks"))), F.lit(0)).alias("chunks"), count("deleted"), count("kept"), count("dropped"), count("failed"))


def has_rows(df: DataFrame) -> bool:
    """Whether any row is there; the scan ends at the first."""
    return not df.isEmpty()


def heal_folders(videos: DataFrame, found: DataFrame) -> DataFrame:
    """videos with the folder their note is found in where the stored one holds no note any more.

    found has (video_id, folder) of the notes on disk; of several folders of one
    video the first by name counts.  A video that is found nowhere keeps what it
    has.  healed marks the rows that changed.
    """
    there = found.select(F.col("folder").alias("_there")).distinct()
    own = found.groupBy(F.col("video_id").alias("_id")).agg(F.min("folder").alias("_new"))
    rows = videos.join(there, F.col("folder") == F.col("_there"), "left").join(own, F.col("video_id") == F.col("_id"), "left")
    moved = F.col("_there").isNull() & F.col("_new").isNotNull()
    kept = [F.when(moved, F.col("_new")).otherwise(F.col("folder")).alias("folder") if c == "folder" else F.col(c) for c in videos.columns]
    return rows.select(*kept, moved.alias("healed"))


def rebuilt_width(vectors: DataFrame, dim: int, *, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors of the current width, rows to embed anew): what a change of width keeps and what it drops, without the vector."""
    fits = F.coalesce(F.size(vector) == dim, F.lit(False))
    return vectors.where(fits), vectors.where(~fits).drop(vector)


def upgraded(tables: dict[str, DataFrame], version: int, steps: dict[int, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]) -> tuple[dict[str, DataFrame], int]:
    """Tables as of the newest version, and its number: every step above theirs, in order; a step maps tables to tables and keeps their ids."""
    for target in sorted(s for s in steps if s > version):
        tables, version = steps[target](tables), target
    return tables, version


def with_known_types(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks whose type the current schema knows, the others): ids and all other columns stay."""
    known = F.coalesce(F.col("chunk_type").isin(*CHUNK_TYPES), F.lit(False))
    return chunks.where(known), chunks.where(~known)


def to_v2(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The second version of the tables: every chunk with its id as it was, orphans too, one a (video_id, chunk_type, chunk_index)."""
    key = ["video_id", "chunk_type", "chunk_index"]
    chunks = tables["chunks"]
    first = chunks.groupBy(*key).agg(F.min("chunk_id").alias("chunk_id"))
    return tables | {"chunks": chunks.join(first, [*key, "chunk_id"], "left_semi").select(*chunks.columns)}


#: What makes tables of a version out of those before it.
STEPS = {2: to_v2}


def statuses(log: DataFrame) -> DataFrame:
    """(folder, state, reason, finished_at) now, from a log (folder, seq, state, reason, at) of begun, indexed and failed.

    A folder counts from its last begun entry on; ends without a beginning do
    not count.  The last end after it says how it went, none means indexing.
    """
    last = F.struct("seq", "state", "reason", "at")
    begun = log.where("state = 'begun'").groupBy("folder").agg(F.max("seq").alias("_from"))
    ends = log.where("state <> 'begun'").join(begun, "folder").where("seq > _from").groupBy("folder").agg(F.max(last).alias("_last"))
    rows = begun.join(ends, "folder", "left")
    return rows.select("folder", F.coalesce("_last.state", F.lit("indexing")).alias("state"), F.col("_last.reason").alias("reason"), F.col("_last.at").alias("finished_at"))


def to_backfill(notes: DataFrame, chunks: DataFrame, frames: DataFrame, *, placeholder: str = "_No on-screen text detected._") -> DataFrame:
    """Notes (video_id, folder, raw) whose on-screen text is still to be done and that have frames.

    Done is a note whose section says that there is no text, or whose texts are
    chunks already; a section that was written but not indexed is done again, so
    a run that was cut short goes on where it ended.
    """
    section = F.col("raw").rlike(r"(?m)^## On-screen text[ \t]*$")
    indexed = chunks.where("chunk_type = 'frame_text'").select(F.col("video_id").alias("_id")).distinct()
    rows = notes.join(indexed, F.col("video_id") == F.col("_id"), "left")
    done = section & (F.contains(F.col("raw"), F.lit(placeholder)) | F.col("_id").isNotNull())
    return rows.where(~F.coalesce(done, F.lit(False))).drop("_id").join(frames.select("folder").distinct(), "folder", "left_semi").select(*notes.columns)


def once(meta: DataFrame, key: str, version: int, job: Callable[[], None]) -> DataFrame:
    """Runs job unless meta says that this version or a later one is done; meta with the mark, which only a job that ended well gets."""
    done = meta.where(F.col("key") == key).agg(F.max(F.col("value").try_cast("int")).alias("v")).first()["v"]
    if done is not None and done >= version:
        return meta
    job()
    return set_meta(meta, key, str(version))


def migration_offer(chunks: DataFrame, videos: DataFrame, meta: DataFrame, active: str, key: str = "migration_offered_for") -> tuple[int, int] | None:
    """(videos, chunks) of other models to offer a migration of; none where there are none or it was offered for this model."""
    if has_rows(meta.where((F.col("key") == key) & (F.col("value") == active))):
        return None
    scope = migration_scope(chunks, videos, active).first()
    return (scope["videos"], scope["chunks"]) if scope["videos"] else None
