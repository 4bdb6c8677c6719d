"""Captions and scraped pages: utterance JSON, WebVTT, SRT, embedded JSON, transcripts in HTML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CUES = "array<struct<start_ms:bigint,text:string>>"


def utterances(body: Column) -> Column:
    """Cues of {"utterances": [{"text", "start_time"}]}; blank texts go; null where there is no such list."""
    parsed = F.from_json(body, "struct<utterances:array<struct<text:string,start_time:double>>>")
    some = F.filter(parsed["utterances"], lambda u: F.coalesce(F.trim(u["text"]), F.lit("")) != "")
    return F.transform(some, lambda u: F.struct(F.coalesce(u["start_time"], F.lit(0.0)).cast("bigint").alias("start_ms"), F.trim(u["text"]).alias("text")))


def webvtt(body: Column) -> Column:
    """Cues of a WebVTT text: a line with -->, then lines up to a blank one; cues without a time or text go."""
    lines = F.regexp_replace(body, r"\r\n?", "\n")
    blocks = F.split(lines, r"\n[ \t]*\n")
    # Before the arrow's line a block may have a number or a name.
    timed = F.filter(blocks, lambda b: F.contains(b, F.lit("-->")))

    def cue(b: Column) -> Column:
        label = F.trim(F.regexp_extract(b, r"(?:^|\n)([^\n]*?)-->", 1))
        text = F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), r"\s*\n\s*", " "))
        return F.struct(T.label_to_ms(label).alias("start_ms"), text.alias("text"))

    return F.filter(F.transform(timed, cue), lambda c: c["start_ms"].isNotNull() & (c["text"] != ""))


def srt(body: Column) -> Column:
    """Cues of an SRT text: as WebVTT, with commas in times."""
    return webvtt(body)


def script_json(html: Column, script_id: str) -> Column:
    """The body of <script id="...">."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<script[^>]*\bid=\"{script_id}\"[^>]*>(.*?)</script>", 1), F.lit(""))


def hydration(html: Column, script_id: str, path: str) -> Column:
    """A value of the JSON that a page's script of this id holds."""
    return F.get_json_object(script_json(html, script_id), path)


def player_formats(body: Column) -> Column:
    """struct<formats, progressive, length_ms>: plain formats, then adaptive ones; the length said, else the longest format's."""
    fmt = "array<struct<itag:int,url:string,mimeType:string,height:int,fps:int,approxDurationMs:string>>"
    parsed = F.from_json(body, f"struct<streamingData:struct<formats:{fmt},adaptiveFormats:{fmt}>,videoDetails:struct<lengthSeconds:string>>")
    none = F.array().cast(fmt)
    plain = F.coalesce(parsed["streamingData"]["formats"], none)
    both = F.concat(plain, F.coalesce(parsed["streamingData"]["adaptiveFormats"], none))
    longest = F.array_max(F.transform(both, lambda x: x["approxDurationMs"].try_cast("bigint")))
    said = F.nullif(parsed["videoDetails"]["lengthSeconds"].try_cast("bigint"), F.lit(0).cast("bigint")) * 1000
    return F.struct(both.alias("formats"), F.size(plain).alias("progressive"), F.coalesce(said, longest).alias("length_ms"))


def find_object(node: object, key: str, depth: int = 60) -> dict | None:
    """The first object, in order of the text, that has a key; not deeper than depth."""
    todo = [(node, 0)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, dict):
            if key in x:
                return x
            below = list(x.values())
        elif isinstance(x, list):
            below = x
        else:
            continue
        if d < depth:
            todo += [(y, d + 1) for y in reversed(below)]
    return None


def deep_search(pages: DataFrame, html: str, key: str, *, out: str = "found") -> DataFrame:
    """pages with the first object that has a key, as JSON, from any of their JSON scripts.

    Only scripts that name the key are parsed: Spark's functions cut and filter
    them, and Python, which recursion needs, sees the rest.
    """
    scripts = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<script[^>]*type="application/json"[^>]*>(.*?)</script>'), F.lit(1))
    some = F.filter(scripts, lambda s: F.contains(s, F.lit(f'"{key}"')))

    def first(lists: pd.Series) -> pd.Series:
        def one(texts) -> str | None:
            for t in texts if texts is not None else ():
                try:
                    hit = find_object(json.loads(t), key)
                except (ValueError, RecursionError):
                    continue
                if hit is not None:
                    return json.dumps(hit, ensure_ascii=False, sort_keys=True)
            return None

        return lists.map(one)

    search = F.pandas_udf(first, "string")
    return pages.withColumn("_s", some).withColumn(out, F.when(F.size("_s") > 0, search("_s"))).drop("_s")


def post_fields(item: Column) -> Column:
    """One shape from two kinds of post record (JSON): each field by the first path that has it."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(item, p) for p in paths))
    number = lambda *paths: F.coalesce(*(F.get_json_object(item, p).try_cast("double") for p in paths)).cast("bigint")
    return F.struct(
        at("$.code", "$.shortcode").alias("code"), at("$.caption.text", "$.edge_media_to_caption.edges[0].node.text").alias("caption"), at("$.user.username", "$.owner.username").alias("author"),
        F.round(F.coalesce(*(F.get_json_object(item, p).try_cast("double") for p in ("$.video_duration", "$.clips_metadata.duration", "$.dash_info.video_duration", "$.duration"))) * 1000).cast("bigint").alias("duration_ms"),
        number("$.play_count", "$.video_view_count", "$.view_count").alias("views"), number("$.like_count", "$.edge_media_preview_like.count").alias("likes"), at("$.clips_metadata.music_info.music_asset_info.title", "$.clips_music_attribution_info.song_name").alias("music"),
    )


def rendered_segments(html: Column) -> Column:
    """array<struct<label, text>> of a saved transcript panel: each segment element's first clock time and its other text."""
    items = F.regexp_extract_all(html, F.lit(r"(?s)<(ytd-transcript-segment-renderer|transcript-segment-view-model)\b[^>]*>(.*?)</\1>"), F.lit(2))

    def one(x: Column) -> Column:
        plain = F.trim(F.regexp_replace(T.html_unescaped(F.regexp_replace(x, r"<[^>]*>", " ")), r"\s+", " "))
        label = F.regexp_extract(plain, r"([0-9]+:[0-9]+(?::[0-9]+)?)", 1)
        text = F.trim(F.regexp_replace(plain, r"^(.*?)[0-9]+:[0-9]+(?::[0-9]+)?", "$1"))
        return F.struct(label.alias("label"), text.alias("text"))

    return F.filter(F.transform(items, one), lambda s: s["text"] != "")


#: Characters that a page's description and its summary are kept to (fixed values).
DESCRIPTION_CUT, SUMMARY_CUT = 2000, 3000


def page_texts(description: Column, summary: Column) -> Column:
    """struct<description, summary> as a page's details hold them: cut to their lengths, empty where there is none."""
    return F.struct(F.left(F.coalesce(description, F.lit("")), F.lit(DESCRIPTION_CUT)).alias("description"), F.left(F.coalesce(summary, F.lit("")), F.lit(SUMMARY_CUT)).alias("summary"))
