"""Indexing notes into stored tables, in batches that can be killed and go on.

Tables of one log: videos, chunks and work, all by video.  A batch's videos and
chunks replace what was there in one snapshot that also says, in work, which
note they came from; so what a killed run had committed is not done again, and
what it had not is not there.  The model that searches ask for is named in the
snapshot only once no chunk of another model is left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.listing import list_files, note_files
from ..sources.snapshots import Tables
from ..sources.vault import note_segments, parse_notes, read_notes
from . import maintain
from .chunking import all_chunks

WORK = "video_id string, folder string, mtime_ms bigint, model_version string, state string, reason string, chunks bigint"
VIDEOS = ["video_id", "raw_id", "platform", "title", "channel", "url", "duration_ms", "date_saved", "tags", "folder"]
#: What the snapshot calls the model that searches ask for.
MODEL_KEY = "current_text_model"


@dataclass
class Summary:
    videos: int = 0
    chunks: int = 0
    failures: int = 0
    dropped: int = 0
    off_model: int = 0


class Reindex:
    """embed takes chunks and adds embedding and model_version; model is that version's name."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame], model: str, *, buckets: int = 64, compat: bool = False) -> None:
        self.tables, self.spark, self.embed, self.model, self.buckets, self.compat = Tables(spark, path), spark, embed, model, buckets, compat

    def _made(self, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(videos, embedded chunks) of notes; of several notes of one video the folder first by name counts."""
        videos = parse_notes(notes)
        one = videos.groupBy("video_id").agg(F.min("path").alias("path"))
        videos = videos.join(one, ["video_id", "path"], "left_semi")
        chunks = self.embed(all_chunks(videos, note_segments(videos), compat=self.compat))
        return videos.select(*VIDEOS), chunks

    def _begin(self, notes: DataFrame) -> None:
        videos, chunks = self._made(notes.limit(0))
        work = self.spark.createDataFrame([], WORK)
        self.tables.create({"videos": (videos, "video_id"), "chunks": (chunks, "video_id"), "work": (work, "folder")}, self.buckets)

    def pending(self, notes: DataFrame) -> DataFrame:
        """Notes (path, folder, mtime_ms, raw) that this model has not done as they are now; the work table says."""
        done = self.tables.read("work").where(F.col("model_version") == self.model).select(F.col("folder").alias("_f"), F.col("mtime_ms").alias("_m"))
        return notes.join(done, (F.col("folder") == F.col("_f")) & (F.col("mtime_ms") <= F.col("_m")), "left_anti")

    def run_vault(self, root: str, *, batch: int = 1_000, progress: Callable[[Summary], None] | None = None) -> Summary:
        """run over a vault's folder: its files are listed, and only pending notes are opened, a batch's at a time."""
        notes = note_files(list_files(self.spark, root)).select("path", "folder", "mtime_ms")
        return self.run(notes, batch=batch, read=lambda paths: read_notes(self.spark, paths), progress=progress)

    def run(self, notes: DataFrame, *, batch: int = 1_000, read: Callable[[list[str]], DataFrame] | None = None, progress: Callable[[Summary], None] | None = None) -> Summary:
        """Drops what has no note any more, then works through what is pending, batch by batch, each one snapshot.

        notes has (path, folder, mtime_ms), and raw unless read gives it for a batch's paths.
        """
        out = Summary()
        if self.tables.log.latest() is None:
            self._begin(notes if read is None else notes.withColumn("raw", F.lit("")))
        gone = maintain.missing(self.tables.read("work"), notes, "folder")
        if not gone.isEmpty():
            out.dropped = gone.count()
            ids = gone.where(F.col("video_id").isNotNull()).select("video_id")
            # A video whose folder was renamed has a note elsewhere and is kept.
            ids = ids.join(self.tables.read("work").join(notes.select("folder").distinct(), "folder", "left_semi").select("video_id"), "video_id", "left_anti")
            drop = lambda rows: rows.join(ids, "video_id", "left_anti")
            folders = gone.select("folder")
            self.tables.change({"videos": drop, "chunks": drop, "work": lambda rows: rows.join(folders, "folder", "left_anti")}, {"videos": ids, "chunks": ids, "work": folders})
        while True:
            due = self.pending(notes).groupBy("folder").agg(F.min("path").alias("path"), F.max("mtime_ms").alias("mtime_ms")).orderBy("folder").limit(batch).collect()  # a batch's names
            if not due:
                break
            names = [r["folder"] for r in due]
            rows = notes.where(F.col("folder").isin(names))
            if read is not None:  # what is listed counts: a note that went or changed since is seen by the next run
                listed = self.spark.createDataFrame([(r["folder"], r["path"], r["mtime_ms"]) for r in due], "folder string, path string, mtime_ms long")
                rows = listed.join(read([r["path"] for r in due]).select("folder", "raw"), "folder", "left")
            self._batch(rows, out)
            if progress:
                progress(out)
        out.off_model = self.tables.read("chunks").where(F.col("model_version") != self.model).count()
        if not out.off_model and self.tables.meta().get(MODEL_KEY) != self.model:
            self.tables.change({}, {}, meta={MODEL_KEY: self.model})
        return out

    def _batch(self, notes: DataFrame, out: Summary) -> None:
        """One snapshot with a batch's videos, chunks and work."""
        videos, chunks = self._made(notes)
        chunks = self.spark.read.parquet(f"{self.tables.log.path}/{(aside := self.tables.log.put(chunks, 'aside'))}")
        counts = chunks.groupBy("video_id").agg(F.count("*").alias("chunks"))
        named = parse_notes(notes).select("folder", "video_id")
        ok = F.col("video_id").isNotNull()
        work = notes.groupBy("folder").agg(F.max("mtime_ms").alias("mtime_ms")).join(named.groupBy("folder").agg(F.min("video_id").alias("video_id")), "folder", "left").join(counts, "video_id", "left")
        work = work.select("video_id", "folder", "mtime_ms", F.lit(self.model).alias("model_version"), F.when(ok, "indexed").otherwise("failed").alias("state"), F.when(~ok, "no id or no closed frontmatter").alias("reason"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))
        self.tables.replace({"videos": videos, "chunks": chunks, "work": work})
        done = work.agg(F.sum(ok.cast("long")), F.sum("chunks"), F.sum((~ok).cast("long"))).first()
        out.videos, out.chunks, out.failures = out.videos + done[0], out.chunks + done[1], out.failures + done[2]
        self.tables.log._fs().delete(self.tables.log._at(aside), True)

    def state(self) -> dict:
        """How far the index is: what the last snapshot holds."""
        work = self.tables.read("work").groupBy("model_version", "state").count().collect()
        return {"snapshot": self.tables.log.latest(), "meta": self.tables.meta(), "work": {(r[0], r[1]): r[2] for r in work}}

