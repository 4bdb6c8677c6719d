"""Registered queries of sources, sinks and stored tables, each beside its DuckDB SQL.

Conversations stand for transcripts (a turn every ten seconds), parts for media
files, events for frames and for what is asked of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, maintain
from ..operators.reindex import Reindex
from ..sources import captions, media, sinks, vault
from ..sources.shared import shared_folder
from ..sources.snapshots import Tables
from .queries import query, read


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def plain(text: Column) -> Column:
    """One line of a text."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_TURNS = f"SELECT conv_id, turn, {_PLAIN} AS text FROM conversations"


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, segments array<struct<ms, text>>) in order of turns."""
    rows = read(spark, sf, "conversations").select("conv_id", F.struct((F.col("turn") * 10_000).alias("ms"), plain(F.col("text")).alias("text")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("segments"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a note (path, folder, mtime_ms, raw) that the writer composes."""
    n = F.col("conv_id").cast("string")
    labelled = F.transform("segments", lambda s: F.struct(T.clock_label(s["ms"]).alias("label"), s["text"].alias("text")))
    rows = transcripts(spark, sf).select(
        "conv_id", F.concat(F.lit('Talk "'), n, F.lit('": a')).alias("title"), F.lit("youtube").alias("platform"), F.concat(F.lit("id"), n).alias("raw_id"), F.concat(F.lit("https://youtu.be/id"), n).alias("url"), F.lit("The: channel").alias("channel"), F.lit("1:30").alias("duration"),
        F.lit("2024-05-06T07:08:09Z").alias("date_saved_text"), F.array(F.lit("a, b"), F.lit("c")).alias("tags"), F.concat(F.lit("About "), n).alias("description"), F.lit("").alias("summary"), labelled.alias("segments"),
    )
    folder = F.concat(F.lit("f"), n)
    return rows.select(F.concat(F.lit("/vault/youtube/"), folder, F.lit("/video.md")).alias("path"), folder.alias("folder"), F.col("conv_id").alias("mtime_ms"), sinks.compose_note().alias("raw"))


@query(f"WITH t AS ({_TURNS}) SELECT 'yt:id' || conv_id AS video_id, 'Talk \"' || conv_id || '\": a' AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, turn * 10000 AS start_ms, lead(turn * 10000) OVER (PARTITION BY conv_id ORDER BY turn) AS end_ms, text FROM t")
def notes_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Notes as they are written, read again: frontmatter and timed lines."""
    videos = vault.parse_notes(notes(spark, sf))
    return vault.note_segments(videos).join(videos.select("video_id", "title"), "video_id").select("video_id", "title", F.col("seq").cast("long").alias("seq"), "start_ms", "end_ms", "text")


@query("SELECT DISTINCT 'yt:id' || conv_id AS video_id, 'The: channel' AS channel, 'https://youtu.be/id' || conv_id AS url, 90000 AS duration_ms, 1714979289000 AS date_saved, 'About ' || conv_id AS description, 'a, b|c' AS tags FROM conversations")
def note_fields(spark: SparkSession, sf: str) -> DataFrame:
    return vault.parse_notes(notes(spark, sf)).select("video_id", "channel", "url", "duration_ms", "date_saved", "description", F.array_join("tags", "|").alias("tags"))




@query(f"WITH t AS ({_TURNS}) SELECT conv_id, kind, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) - 1 AS seq, turn * 10000 AS start_ms, text FROM t, (VALUES ('json'), ('srt'), ('vtt')) k(kind)")
def caption_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Transcripts written as WebVTT, SRT and utterance JSON, and the cues of each."""
    rows = transcripts(spark, sf)
    clock = lambda s, point: F.concat(F.lit("00:"), F.lpad(F.floor(s["ms"] / 60_000).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s["ms"] / 1000 % 60).cast("string"), 2, "0"), F.lit(f"{point}000"))
    blocks = lambda point: F.array_join(F.transform("segments", lambda s: F.concat(clock(s, point), F.lit(" --> 01:00:00.000\n"), s["text"])), "\n\n")
    said = F.to_json(F.struct(F.transform("segments", lambda s: F.struct(s["text"].alias("text"), s["ms"].alias("start_time"))).alias("utterances")))
    kinds = {"vtt": captions.webvtt(F.concat(F.lit("WEBVTT\n\n"), blocks("."))), "srt": captions.srt(blocks(",")), "json": captions.utterances(said)}
    cues = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.cast(captions.CUES).alias("cues")) for k, c in kinds.items()))).alias("k")
    return rows.select("conv_id", cues).select("conv_id", "k.kind", F.posexplode("k.cues").alias("seq", "cue")).select("conv_id", "kind", F.col("seq").cast("long").alias("seq"), "cue.start_ms", "cue.text")


def _word(*values: Column | int) -> Column:
    """Big-endian 32-bit numbers as hex."""
    return F.concat(*(F.lpad(F.hex(v if isinstance(v, Column) else F.lit(v)), 8, "0") for v in values))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size * 100 AS a, p_size * 7 + 1 AS b FROM part),
r AS (SELECT k, 0 AS seq, 56 + 8 AS position, a AS size, k * 1000.0 / 90000 AS pts_ms, 45000 * 1000.0 / 90000 AS duration_ms FROM p
 UNION ALL SELECT k, 1, 56 + 8 + a, b, (k + 45000) * 1000.0 / 90000, 90000 * 1000.0 / 90000 FROM p)
SELECT k::BIGINT AS p_partkey, seq::BIGINT AS seq, position::BIGINT AS position, size::BIGINT AS size, round(pts_ms::DOUBLE, 6) AS pts_ms, round(duration_ms::DOUBLE, 6) AS duration_ms FROM r""")
def media_segments(spark: SparkSession, sf: str) -> DataFrame:
    """A segment index a part, as bytes, and the segments it lists."""
    k, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    head = F.concat(_word(56), F.hex(F.lit("sidx")), _word(0, 1, 90_000, k, F.lit(8)), F.lit("00000002"))
    content = F.unhex(F.concat(head, _word(size * 100, F.lit(45_000), F.lit(0)), _word(size * 7 + 1, F.lit(90_000), F.lit(0))))
    files = read(spark, sf, "part").select(k.cast("string").alias("path"), content.alias("content"))
    return media.segment_rows(files).select(F.col("path").cast("long").alias("p_partkey"), F.col("seq").cast("long").alias("seq"), "position", "size", F.round("pts_ms", 6).alias("pts_ms"), F.round("duration_ms", 6).alias("duration_ms"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_size AS a FROM part)
SELECT k::BIGINT AS p_partkey, seq::BIGINT AS seq, (200 + CASE WHEN seq = 0 THEN 0 ELSE a END)::BIGINT AS position, (a + seq)::BIGINT AS size, (k + seq * 40)::BIGINT AS dts, (k + seq * 40 + seq * 20)::BIGINT AS pts, seq = 0 AS is_sync FROM p, range(2) r(seq)""")
def media_samples(spark: SparkSession, sf: str) -> DataFrame:
    """A fragment of two samples a part, as bytes, and the samples it lists: running times and places."""
    k, size = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    box = lambda kind, n, body: F.concat(_word(n), F.hex(F.lit(kind)), body)
    run = box("trun", 52, F.concat(F.lit("00000F01"), _word(2, 200), _word(F.lit(40), size, F.lit(0x02000000), F.lit(0)), _word(F.lit(40), size + 1, F.lit(0x01010000), F.lit(20))))
    track = F.concat(box("tfhd", 16, _word(0, 1)), box("tfdt", 16, _word(F.lit(0), k)), run)
    content = F.unhex(box("moof", 100, box("traf", 92, track)))
    files = read(spark, sf, "part").select(k.cast("string").alias("path"), content.alias("content"))
    return media.sample_rows(files).select(F.col("path").cast("long").alias("p_partkey"), F.col("seq").cast("long").alias("seq"), "position", "size", "dts", "pts", "is_sync")


@query("""SELECT 'f' || doc_id AS folder, doc_id::VARCHAR AS "videoID", 'T "' || doc_id || '"' AS title, source AS channel, lpad((n_chars % 1000)::VARCHAR, 4, '0') AS "dateSaved", lang AS platform FROM documents WHERE doc_id % 10 <> 3""")
def manifest_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the documents, written and read; entries whose folder leaves the vault are not written."""
    n = F.col("doc_id").cast("string")
    folder = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("../f"), n)).otherwise(F.concat(F.lit("f"), n))
    date = F.lpad((F.col("n_chars") % 1000).cast("string"), 4, "0")
    entries = read(spark, sf, "documents").select(folder.alias("folder"), n.alias("videoID"), F.concat(F.lit('T "'), n, F.lit('"')).alias("title"), F.col("source").alias("channel"), F.lit("0:01").alias("duration"), date.alias("dateSaved"), F.array(F.lit("x")).alias("tags"), F.lit("u").alias("url"), F.col("lang").alias("platform"))
    root = fresh_folder(spark, "manifest")
    sinks.write_manifest(entries, f"{root}/manifest.json")
    return vault.read_manifest(spark, root).select("folder", "videoID", "title", "channel", "dateSaved", "platform")


@query("""
WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents), v AS (SELECT DISTINCT source FROM d)
SELECT 'documents' AS table_name, source, count(*) AS n, sum(n_chars)::BIGINT AS total FROM d WHERE source NOT IN ('src1', 'src2', 'src3') GROUP BY source
UNION ALL SELECT 'documents', 'src1', 1, 7 UNION ALL SELECT 'documents', 'added', 1, 8
UNION ALL SELECT 'sources', source, 1, 0 FROM v WHERE source NOT IN ('src2', 'src3')""")
def stored_change(spark: SparkSession, sf: str) -> DataFrame:
    """Two stored tables: one source's documents replaced, a new one's added, two sources deleted from both."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    tables = Tables(spark, fresh_folder(spark, "stored"))
    tables.create({"documents": (docs, "source"), "sources": (docs.select("source").distinct(), "source")}, buckets=8)
    tables.replace({"documents": spark.createDataFrame([(-1, "en", "src1", 7), (-2, "en", "added", 8)], docs.schema)})
    tables.delete(spark.createDataFrame([("src2",), ("src3",)], "source string"))
    own = tables.read("documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"))
    both = own.select(F.lit("documents").alias("table_name"), "source", "n", "total")
    return both.unionByName(tables.read("sources").groupBy("source").agg(F.count("*").alias("n")).select(F.lit("sources").alias("table_name"), "source", "n", F.lit(0).cast("long").alias("total")))


@query(r"""SELECT DISTINCT 'yt:id' || conv_id AS video_id, 'Title: Talk "' || conv_id || '": a' || chr(10) || 'Channel: The: channel' || chr(10) || 'Platform: youtube' || chr(10) || 'Tags: a, b, c' || chr(10) || 'Duration: 1:30' AS chunk_text, 'lengths' AS model_version, 'indexed' AS state, 'lengths' AS current_model FROM conversations""")
def reindexed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of all conversations indexed in batches of two snapshots or more: header chunks, the work's state, the model that searches ask for."""
    embed = lambda chunks: chunks.withColumn("embedding", F.array(F.length("embedding_input").cast("float"))).withColumn("model_version", F.lit("lengths"))
    rows = notes(spark, sf)
    job = Reindex(spark, fresh_folder(spark, "reindex"), embed, "lengths", buckets=8)
    job.run(rows, batch=max(1, -(-rows.count() // 2)))
    headers = job.tables.read("chunks").where("chunk_type = 'header'").join(job.tables.read("work").select("video_id", "state"), "video_id")
    return headers.select("video_id", "chunk_text", "model_version", "state", F.lit(job.tables.meta().get("current_text_model")).alias("current_model"))


_ASKED = """
WITH l AS (SELECT event_id, user_id AS u, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events WHERE event_type = 'error'),
r AS (SELECT event_id AS rid, user_id AS u, epoch_us(ts) AS rt FROM events WHERE event_type = 'view')"""


def _frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "events").select("event_id", F.col("user_id").alias("video_id"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return e.where("event_type = 'error'"), e.where("event_type = 'view'").select("video_id", F.col("event_id").alias("frame_id"), F.col("t").alias("frame_ms"))


@query(_ASKED + """,
n AS (SELECT l.u, l.place, rid, rt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(rt - t), rt, rid) AS n FROM l JOIN r ON l.u = r.u),
f AS (SELECT u, rid, rt, min(place) AS place FROM n WHERE n = 1 GROUP BY ALL)
SELECT u AS video_id, rid AS frame_id, rt AS frame_ms FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY place) AS m FROM f) WHERE m <= 2""")
def frames_of_times(spark: SparkSession, sf: str) -> DataFrame:
    """Views stand for frames, errors for the times asked of a user's video; two frames of each."""
    asked, frames = _frames(spark, sf)
    place = F.row_number().over(asof.Window.partitionBy("video_id").orderBy("event_id"))
    return asof.frames_for_times(asked.select("video_id", place.alias("place"), F.col("t").alias("at_ms")), frames, 2)


@query(_ASKED + """,
c AS (SELECT event_id, u, t + 1800000000 AS mid, event_id % 7 = 0 AS head, u % 2 = 0 AS short FROM l),
a AS (SELECT event_id, rid, row_number() OVER (PARTITION BY event_id ORDER BY abs(rt - mid), rt DESC, rid) AS n FROM c JOIN r USING (u)),
b AS (SELECT event_id, rid, row_number() OVER (PARTITION BY event_id ORDER BY abs(rt - mid - 10000), rt DESC, rid) AS n FROM c JOIN r USING (u))
SELECT c.event_id, CASE WHEN head OR a.rid IS NULL THEN '' WHEN b.rid <> a.rid AND NOT short THEN a.rid || ',' || b.rid ELSE a.rid::VARCHAR END AS frame_ids
FROM c LEFT JOIN a ON a.event_id = c.event_id AND a.n = 1 LEFT JOIN b ON b.event_id = c.event_id AND b.n = 1""")
def frames_of_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Errors stand for chunks of an hour, every seventh for a header; the frame nearest the middle and the one ten seconds on."""
    asked, frames = _frames(spark, sf)
    rows = asked.select("event_id", "video_id", F.col("t").alias("chunk_start_ms"), (F.col("t") + 3_600_000_000).alias("chunk_end_ms"), F.when(F.col("event_id") % 7 == 0, "header").otherwise("body").alias("chunk_type"), F.when(F.col("video_id") % 2 == 0, 20_000).otherwise(100_000).alias("duration_ms"))
    return asof.frames_for_chunks(rows, frames).select("event_id", F.array_join(F.col("frame_ids").cast("array<string>"), ",").alias("frame_ids"))


@query("SELECT count(*) FILTER (event_type = 'view') AS videos, coalesce(sum(user_id) FILTER (event_type = 'view'), 0)::BIGINT AS chunks, count(*) FILTER (event_type = 'click') AS deleted, count(*) FILTER (event_type = 'purchase') AS kept, 0::BIGINT AS dropped, count(*) FILTER (event_type = 'error') AS failed FROM events")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "indexed").when(F.col("event_type") == "click", "deleted").when(F.col("event_type") == "purchase", "kept").when(F.col("event_type") == "error", "failed").otherwise("other")
    return maintain.summary(read(spark, sf, "events").select(F.col("event_id").alias("video_id"), action.alias("action"), F.col("user_id").alias("chunks")))


@query("""
WITH p AS (SELECT page_id, url, html, list_transform(range(0, page_id % 400), lambda x: x) AS ids FROM pages)
SELECT page_id, contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') OR contains(lower(url), 'tiktok.com') OR contains(lower(url), 'instagram.com') AS link,
 length(left(html, 2000)) AS description, length(left(html, 3000)) AS summary, array_to_string(CASE WHEN len(ids) <= 256 THEN ids ELSE list_concat(ids[1:255], ids[-1:]) END, ',') AS ids, greatest(page_id, CASE WHEN page_id % 3 > 0 THEN 500 END) AS duration FROM p""")
def page_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an address is taken, the cuts of a page's texts, ids cut to an encoder's width, the longer of two durations."""
    n = F.col("page_id")
    ids = F.when(n % 400 > 0, F.sequence(F.lit(0).cast("long"), n % 400 - 1)).otherwise(F.array().cast("array<bigint>"))
    cut = captions.page_texts(F.col("html"), F.col("html"))
    measured = F.when(n % 3 > 0, F.lit(500).cast("long")).otherwise(F.lit(-1).cast("long"))
    return read(spark, sf, "pages").select("page_id", T.is_supported_link(F.col("url")).alias("link"), F.length(cut["description"]).alias("description"), F.length(cut["summary"]).alias("summary"), F.array_join(T.truncated_ids(ids).cast("array<string>"), ",").alias("ids"), T.longest_ms(n, measured).alias("duration"))


@query()
def wrapped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Texts wrapped at eighty characters: a fold over words, tested against a loop."""
    lines = T.wrapped(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(lines).alias("lines"), F.array_max(F.transform(lines, lambda x: F.length(x))).alias("longest"))


@query("""
WITH b AS (SELECT doc_id, 'v' || doc_id % 50 AS video_id, CASE doc_id % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'description' WHEN 2 THEN 'body' ELSE 'frame_text' END AS chunk_type, doc_id // 200 AS chunk_index FROM documents)
SELECT video_id, chunk_type, chunk_index, min(doc_id) AS chunk_id FROM b GROUP BY ALL""")
def upgraded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the first version of the tables as of the newest: ids stay, one a key."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(k) for k in maintain.CHUNK_TYPES)), (n % 4 + 1).cast("int"))
    chunks = read(spark, sf, "documents").select(n.alias("chunk_id"), F.concat(F.lit("v"), (n % 50).cast("string")).alias("video_id"), kind.alias("chunk_type"), F.floor(n / 200).cast("long").alias("chunk_index"))
    tables, version = maintain.upgraded({"chunks": chunks}, 1, maintain.STEPS)
    return tables["chunks"].where(F.lit(version) == 2)


@query(r"""
WITH s AS (SELECT conv_id, string_agg('[' || turn * 10 // 60 || ':' || lpad((turn * 10 % 60)::VARCHAR, 2, '0') || '] ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn) FILTER (conv_id % 3 = 0) AS said FROM conversations GROUP BY conv_id)
SELECT conv_id, conv_id % 2 = 0 AS written, 'note' || conv_id || CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || '## On-screen text' || chr(10) || chr(10) || coalesce(said, '_No on-screen text detected._') || chr(10) ELSE '' END AS raw FROM s""")
def screen_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of every third conversation stand for recognised lines; every second one's folder has frames."""
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    own = rows.select("conv_id").distinct()
    name = F.col("conv_id").cast("string")
    held = own.select("conv_id", name.alias("video_id"), name.alias("folder"), F.concat(F.lit("note"), name).alias("raw"))
    lines = rows.where("conv_id % 3 = 0").select(name.alias("video_id"), (F.col("turn") * 10_000).alias("ms"), "text")
    return sinks.with_screen_text(held, lines, own.where("conv_id % 2 = 0").select(name.alias("folder"))).select("conv_id", "written", "raw")
