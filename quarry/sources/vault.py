"""Notes of a vault: scan, parse, list frames, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

PLATFORMS = ("youtube", "instagram", "tiktok")
MANIFEST = "folder string, videoID string, title string, channel string, duration string, dateSaved string, tags array<string>, url string, platform string"


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, raw) of every video.md below a platform's folder, or below the root itself as older vaults have it."""
    globs = [f"{root}/{{{','.join(PLATFORMS)}}}/*/video.md", f"{root}/*/video.md"]
    found: DataFrame | None = None
    for glob in globs:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "video.md").option("ignoreMissingFiles", "true")
        try:
            part = files.load(glob).select("path", "modificationTime", F.decode("content", "UTF-8").alias("raw"))
        except Exception as e:  # no folder of that shape: the vault may have the other only
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "path string, modificationTime timestamp, raw string")
    return found.withColumn("folder", F.element_at(F.split("path", "/"), -2)).withColumn("mtime_ms", F.unix_millis("modificationTime")).drop("modificationTime")


def read_notes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, folder, mtime_ms, raw) of these notes, no others are opened; one that is gone meanwhile has no row."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.unix_millis("modificationTime").alias("mtime_ms"), F.decode("content", "UTF-8").alias("raw"))


def frontmatter(raw: Column) -> Column:
    """The lines between a first line --- and the next; null where there are none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\A---[ \t]*\r?\n(.*?\n)---[ \t]*(?:\r?\n|\z)", 1), F.lit(""))


def frontmatter_map(raw: Column) -> Column:
    """key: value pairs of the frontmatter, quotes undone; a list of "  - item" lines comes as [item, item]; the first of a key counts."""
    folded = F.regexp_replace(frontmatter(raw), r"\r", "")
    # "key:" and its items become one line before lines part.
    folded = F.regexp_replace(folded, r"\n[ \t]+-[ \t]*", "\u0001")
    lines = F.filter(F.split(folded, "\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))

    def pair(line: Column) -> Column:
        key = F.trim(F.regexp_extract(line, r"^([^:]+):", 1))
        rest = F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1))
        items = F.regexp_replace(F.regexp_replace(rest, "^\u0001", ""), "\u0001", ", ")
        value = F.when(F.contains(rest, F.lit("\u0001")), F.concat(F.lit("["), items, F.lit("]"))).otherwise(T.yaml_unquoted(rest))
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.transform(lines, pair)
    once = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))
    return F.map_from_entries(once)


def sections(raw: Column) -> Column:
    """array<struct<heading, body>> of the note's ## sections."""
    body = T.without_frontmatter(F.regexp_replace(raw, r"\r", ""))
    parts = F.filter(F.split(F.concat(F.lit("\n"), body), r"\n(?=## )"), lambda p: F.startswith(p, F.lit("## ")))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^## ([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"^## [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))


def description(raw: Column) -> Column:
    """Bodies of Caption, Description and Summary, in order, a blank line between."""
    wanted = F.filter(sections(raw), lambda s: s["heading"].isin("Caption", "Description", "Summary") & (s["body"] != ""))
    return F.array_join(F.transform(wanted, lambda s: s["body"]), "\n\n")


def segment_lines(raw: Column, heading: str, *, strict: bool = False) -> Column:
    """array<struct<ms, text>> of the "[label] text" lines of a section; placeholders and lines without a label go."""
    own = F.get(F.filter(sections(raw), lambda s: s["heading"] == heading), F.lit(0))["body"]
    lines = F.filter(F.transform(F.split(F.coalesce(own, F.lit("")), "\n"), F.trim), lambda x: x.rlike(r"^\[[^\]]*\]"))
    pairs = F.transform(lines, lambda x: F.struct(T.label_to_ms(F.regexp_extract(x, r"^\[([^\]]*)\]", 1), strict=strict).alias("ms"), F.trim(F.regexp_replace(x, r"^\[[^\]]*\]", "")).alias("text")))
    return F.filter(pairs, lambda p: p["ms"].isNotNull())


def parse_notes(notes: DataFrame, *, strict: bool = False) -> DataFrame:
    """Notes with an id and a closed frontmatter as videos; others go, whatever they hold."""
    fm = frontmatter_map(F.col("raw"))
    rows = notes.withColumn("fm", fm).where(F.col("fm").isNotNull())
    get = lambda *keys: F.coalesce(*(F.nullif(F.try_element_at("fm", F.lit(k)), F.lit("")) for k in keys), F.lit(""))
    rows = rows.withColumn("raw_id", get("video_id", "post_id")).where((F.col("raw_id") != "") & ~T.escapes_folder(F.col("folder")))
    platform = F.coalesce(F.nullif(get("platform"), F.lit("")), F.lit("youtube"))
    rows = rows.withColumn("platform", platform)
    return rows.select(
        T.qualified_id(F.col("platform"), F.col("raw_id")).alias("video_id"), "raw_id", "platform", get("title").alias("title"), get("channel", "author_display_name", "author").alias("channel"),
        F.coalesce(F.nullif(get("url"), F.lit("")), T.default_url(F.col("platform"), F.col("raw_id"))).alias("url"), get("duration").alias("duration"), T.label_to_ms(get("duration")).alias("duration_ms"),
        get("date_saved").alias("date_saved_text"), T.iso_to_ms(get("date_saved"), F.col("mtime_ms")).alias("date_saved"), T.tag_list(get("tags", "hashtags")).alias("tags"),
        description(F.col("raw")).alias("description"), segment_lines(F.col("raw"), "Transcript", strict=strict).alias("transcript"), segment_lines(F.col("raw"), "On-screen text", strict=strict).alias("screen"), "folder", "path", "mtime_ms",
    )


def note_segments(videos: DataFrame) -> DataFrame:
    """(video_id, kind, seq, start_ms, end_ms, text): a segment ends where the next begins."""
    part = lambda c, kind: videos.select("video_id", F.lit(kind).alias("kind"), F.posexplode(c).alias("seq", "s"))
    rows = part("transcript", "body").unionByName(part("screen", "frame_text"))
    rows = rows.select("video_id", "kind", "seq", F.col("s.ms").alias("start_ms"), F.col("s.text").alias("text"))
    return rows.withColumn("end_ms", F.lead("start_ms").over(Window.partitionBy("video_id", "kind").orderBy("seq")))


def manifest_of(videos: DataFrame) -> DataFrame:
    """The manifest's rows, newest first."""
    rows = videos.select("folder", F.col("raw_id").alias("videoID"), "title", "channel", "duration", F.col("date_saved_text").alias("dateSaved"), "tags", "url", "platform")
    return rows.orderBy(F.col("dateSaved").desc(), "videoID")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """manifest.json, a bare array or {"videos": [...]}; where it is missing or holds no row, the notes say."""
    try:
        raw = spark.read.text(f"{root}/manifest.json", wholetext=True)
        kind = f"array<struct<{_struct(MANIFEST)}>>"
        # The held list first: an object read as an array is an array of one.
        rows = raw.select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$.videos"), kind), F.from_json("value", kind))).alias("r")).select("r.*").where(F.col("videoID").isNotNull())
        if not rows.isEmpty():
            return rows
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return manifest_of(parse_notes(scan_notes(spark, root)))


def _struct(ddl: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in ddl.split(", "))


def list_frames(spark: SparkSession, root: str, *, least_digits: int = 1) -> DataFrame:
    """(folder, frame_ms, path) of JPEGs named by their milliseconds; indexing asks for eight digits. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(root)
    stem = F.regexp_extract("path", r"/([0-9]+)\.jpg$", 1)
    return files.select("path", stem.alias("stem")).where(F.length("stem") >= least_digits).select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("stem").try_cast("bigint").alias("frame_ms"), "path").where(F.col("frame_ms").isNotNull())
