"""Writing notes, manifests and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def compose_note(*, short_form: bool = False) -> Column:
    """A note's text from columns title, platform, raw_id, url, channel, duration, date_saved_text, tags, description, summary
    and segments, an array<struct<label, text>>; a short-form note has a caption and a placeholder where nothing is said."""
    tags = F.array_join(F.transform("tags", T.yaml_quoted), ", ")
    id_key = "post_id: " if short_form else "video_id: "
    head = [F.lit("---"), F.concat(F.lit("title: "), T.yaml_quoted(F.col("title"))), F.concat(F.lit("platform: "), F.col("platform")), F.concat(F.lit(id_key), F.col("raw_id")), F.concat(F.lit("url: "), F.col("url")), F.concat(F.lit("author: " if short_form else "channel: "), T.yaml_quoted(F.col("channel"))), F.concat(F.lit('duration: "'), F.col("duration"), F.lit('"')), F.concat(F.lit("date_saved: "), F.col("date_saved_text")), F.concat(F.lit("hashtags: [" if short_form else "tags: ["), tags, F.lit("]")), F.lit("---"), F.lit("")]

    def section(title: str, body: Column) -> Column:
        return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n")))

    lines = F.array_join(F.transform("segments", lambda s: F.concat(F.lit("["), s["label"], F.lit("] "), s["text"])), "\n")
    said = F.when(F.size("segments") > 0, lines).otherwise(F.lit("_No speech detected._" if short_form else ""))
    return F.concat(F.concat_ws("\n", *head, section("Caption" if short_form else "Description", F.col("description")), section("Summary", F.col("summary")), F.concat(F.lit("## Transcript\n\n"), said)), F.lit("\n"))


def write_notes(videos: DataFrame, path: str, *, short_form: bool = False) -> None:
    """Notes as a Parquet table (folder, note), a partition per platform; a folder of files is the caller's own choice."""
    videos.select("platform", T.folder_name(F.col("channel"), F.col("title"), F.col("raw_id")).alias("folder"), compose_note(short_form=short_form).alias("note")).write.mode("overwrite").partitionBy("platform").parquet(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Entries that have an id and a folder inside the vault as one JSON array, newest first, an entry a line.

    A manifest is one document, so one task writes it; it sorts with spilling
    and holds no more than a row.
    """
    own = entries.where((F.coalesce("videoID", F.lit("")) != "") & ~F.coalesce(T.escapes_folder(F.col("folder")), F.lit(False)))
    place = F.row_number().over(Window.orderBy(F.col("dateSaved").desc(), "videoID"))
    line = F.concat(F.when(F.col("_n") == 1, "[").otherwise(","), F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}))
    rows = own.withColumn("_n", place).select(line.alias("value"))
    end = own.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, "[]").otherwise("]").alias("value"))
    rows.unionAll(end).coalesce(1).write.mode("overwrite").text(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: The heading of on-screen text in a note, and what stands there where none was found (fixed values).
SCREEN_HEADING, NO_SCREEN_TEXT = "## On-screen text", "_No on-screen text detected._"


def with_screen_text(notes: DataFrame, lines: DataFrame, frames: DataFrame) -> DataFrame:
    """notes (video_id, folder, raw) with a section of their recognised lines (video_id, ms, text), and written, whether it was added.

    A note that has the section already, or whose folder has no frames (folder)
    yet, stays as it is; one without lines gets a placeholder, so that it counts
    as done.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    own = lines.where(text != "").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ms", F.concat(F.lit("["), T.clock_label(F.col("ms")), F.lit("] "), text).alias("line")))).alias("_l"))
    rows = notes.join(own, "video_id", "left").join(frames.select("folder").distinct().withColumn("_f", F.lit(True)), "folder", "left")
    due = F.coalesce("_f", F.lit(False)) & ~F.contains("raw", F.lit(SCREEN_HEADING))
    body = F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).otherwise(F.lit(NO_SCREEN_TEXT))
    end = F.when(F.endswith("raw", F.lit("\n")), F.lit("")).otherwise(F.lit("\n"))
    raw = F.when(due, F.concat("raw", end, F.lit(f"\n{SCREEN_HEADING}\n\n"), body, F.lit("\n"))).otherwise(F.col("raw"))
    return rows.select(*(raw.alias("raw") if c == "raw" else F.col(c) for c in notes.columns), due.alias("written"))
