"""Choosing one of several: streams, captions, renditions, platforms, keyword matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Codecs that a stream may have, best first.
CODECS = ("avc1", "vp9", "av01")


def codec_rank(mime: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(CODECS))):
        out = F.when(F.contains(F.lower(mime), F.lit(c)), F.lit(i)).otherwise(out)
    return out


def stream_candidates(formats: DataFrame, by: str) -> DataFrame:
    """Formats of a known codec, with an address and a height, that run nine tenths of the longest at least."""
    longest = F.max("duration_ms").over(Window.partitionBy(by))
    rows = formats.withColumn("_codec", codec_rank(F.col("mime"))).withColumn("_long", longest)
    return rows.where(F.col("_codec").isNotNull() & (F.coalesce("url", F.lit("")) != "") & F.col("height").isNotNull() & (F.coalesce("duration_ms", F.lit(0)) >= 0.9 * F.coalesce("_long", F.lit(0)))).drop("_long")


def best_stream(formats: DataFrame, by: str, target: int) -> DataFrame:
    """One format of each group: the target height, else the highest below, else the lowest above; then no high frame rate; then codec."""
    h = F.col("height")
    where = F.when(h == target, 0).when(h < target, 1).otherwise(2)
    near = F.when(h < target, -h).otherwise(h)
    order = F.struct(where.alias("side"), near.alias("near"), (F.coalesce("fps", F.lit(0)) > 30).alias("fast"), F.col("_codec").alias("codec"), F.col("format_id").alias("id"))
    rows = stream_candidates(formats, by)
    kept = [c for c in rows.columns if c != "_codec"]
    return rows.groupBy(by).agg(F.min_by(F.struct(*kept), order).alias("r")).select("r.*")


def heights(formats: DataFrame, by: str) -> DataFrame:
    return formats.groupBy(by).agg(F.array_sort(F.collect_set("height")).alias("heights"))


def pick_caption(infos: Column) -> Column:
    """The first English track, else the first, of array<struct<lang, url>>."""
    english = F.filter(infos, lambda x: F.startswith(F.lower(x["lang"]), F.lit("en")))
    return F.coalesce(F.get(english, F.lit(0)), F.get(infos, F.lit(0)))


def pick_rendition(items: Column) -> Column:
    """The first with an http address, else the first, of array<struct<url, ...>>."""
    return F.coalesce(F.get(F.filter(items, lambda x: F.startswith(x["url"], F.lit("http"))), F.lit(0)), F.get(items, F.lit(0)))


def pick_locale(wanted: Column, offered: Column) -> Column:
    """The locale itself, else one of its language, else en-US, else the first offered."""
    lang = F.lower(F.split(wanted, "[-_]")[0])
    exact = F.get(F.filter(offered, lambda x: F.lower(F.replace(x, F.lit("_"), F.lit("-"))) == F.lower(F.replace(wanted, F.lit("_"), F.lit("-")))), F.lit(0))
    alike = F.get(F.filter(offered, lambda x: F.lower(F.split(x, "[-_]")[0]) == lang), F.lit(0))
    default = F.get(F.filter(offered, lambda x: F.lower(x) == "en-us"), F.lit(0))
    return F.coalesce(exact, alike, default, F.get(offered, F.lit(0)))


def list_videos(videos: DataFrame, *, platform: str | None = None, channel: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, at most limit (1 to 1000); platform and channel match exactly."""
    if platform is not None:
        videos = videos.where(F.col("platform") == platform)
    if channel is not None:
        videos = videos.where(F.col("channel") == channel)
    return videos.orderBy(F.col("date_saved").desc(), "video_id").limit(max(1, min(int(limit), 1000)))


def platform_flag(value: str | None) -> str | None:
    """A platform as a command line gives it: any case, blanks around it; nothing given is none."""
    folded = (value or "").strip().lower()
    return folded or None


def keyword_search(entries: DataFrame, query: str, limit: int = 10, *, id: str = "video_id", fields: tuple[str, ...] = ("title", "channel", "tags", "platform"), date: str = "date_saved") -> DataFrame:
    """Entries that have all the query's words in one of the fields; a word at the start of one counts double; no words, no rows."""
    hay = F.lower(F.concat_ws(" ", *(F.concat_ws(" ", F.col(f)) for f in fields)))
    tokens = T.search_tokens(F.lit(query))
    rows = entries.withColumn("_hay", hay).withColumn("_tok", tokens).where(F.size("_tok") > 0)
    rows = rows.withColumn("score", T.keyword_weight(F.col("_hay"), F.col("_tok"))).where("score > 0")
    return rows.drop("_hay", "_tok").orderBy(F.col("score").desc(), F.col(date).desc(), id).limit(limit)


def resolve_identifier(entries: DataFrame, needle: str, *, raw: str = "raw_id", qualified: str = "video_id", url: str = "url", order: str = "position") -> DataFrame:
    """The entry an address or id names: equal address or id first, then what ends with the qualified id, then what contains the raw one."""
    n = F.lit(needle)
    rank = F.when((F.col(url) == n) | (F.col(qualified) == n) | (F.col(raw) == n), 0).when(F.endswith(n, F.col(qualified)), 1).when((F.length(raw) > 0) & F.contains(n, F.col(raw)), 2)
    return entries.withColumn("_rank", rank).where(F.col("_rank").isNotNull()).orderBy("_rank", order).limit(1).drop("_rank")


def screen_lines(lines: DataFrame, *, least_confidence: float = 0.4, least_length: int = 3) -> DataFrame:
    """Recognised lines (video_id, text, confidence, title, channel, transcript) worth keeping: sure, long enough, neither title nor channel nor said in the transcript."""
    norm = T.normalized(F.col("text"))
    other = lambda c: T.normalized(F.coalesce(F.col(c), F.lit("")))
    return lines.where((F.col("confidence") >= least_confidence) & (F.length(norm) >= least_length) & (norm != other("title")) & (norm != other("channel")) & ~F.contains(other("transcript"), norm))


#: Long edges of the heights that a user may ask for; any other counts as 1080.
LONG_EDGES = {720: 1280, 1080: 1920, 1440: 2560, 2160: 3840}


def long_edge(width: Column, height: Column, target: Column | int) -> Column:
    """The long edge to save at: the target's, or the source's own where that is known and smaller."""
    target = target if isinstance(target, Column) else F.lit(target)
    cap = F.lit(LONG_EDGES[1080])
    for asked, edge in LONG_EDGES.items():
        cap = F.when(target == asked, F.lit(edge)).otherwise(cap)
    source = F.greatest(width, height)
    return F.when(F.coalesce(source, F.lit(0)) <= 0, cap).otherwise(F.least(source, cap))


def output_size(width: Column, height: Column, most: Column | int) -> Column:
    """struct<width, height> of the same aspect with no edge over most; never larger than the source, and the source's own where most is not positive."""
    most = most if isinstance(most, Column) else F.lit(most)
    w, h = F.abs(width).cast("double"), F.abs(height).cast("double")
    scale = F.when((most > 0) & (F.greatest(w, h) > most), most / F.greatest(w, h)).otherwise(F.lit(1.0))
    return F.struct(F.round(w * scale).cast("int").alias("width"), F.round(h * scale).cast("int").alias("height"))


def pick_video(bitrates: Column, direct: Column, *, own_host: str = "www.tiktok.com") -> Column:
    """The address to load of array<struct<codec, urls>>, null where none is usable.

    Entries count by codec, in their own order among equals: H.264, then HEVC,
    then unknown ones, never the kind that does not play.  Of the first entry
    that has an https address outside the platform's own host that address is
    taken, if it is its first such; else the direct one, if it is https.
    """
    codec = lambda b: F.lower(F.coalesce(b["codec"], F.lit("")))
    rank = lambda b: F.when(codec(b).rlike("h264"), 0).when(codec(b).rlike("bytevc1|hevc"), 1).when(~codec(b).rlike("bytevc2"), 2)
    first = lambda b: F.get(F.filter(b["urls"], lambda u: ~F.contains(u, F.lit(own_host))), F.lit(0))
    secure = lambda u: F.coalesce(F.startswith(F.lower(u), F.lit("https://")), F.lit(False))
    ranked = F.transform(bitrates, lambda b, i: F.struct(rank(b).alias("rank"), i.alias("place"), first(b).alias("url")))
    usable = F.array_sort(F.filter(ranked, lambda r: r["rank"].isNotNull() & secure(r["url"])))
    return F.coalesce(F.get(usable, F.lit(0))["url"], F.when(secure(direct), direct))
