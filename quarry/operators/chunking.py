"""Cutting notes into chunks: header, description, and timed segments with overlap.

Segments of a video are a fold in time, so each (video, kind) is one group of
``applyInPandas``; a group is one video's transcript, never a corpus.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, OVERLAP, DESCRIPTION_LEAST, HARD_CAP = 400, 60, 50, 1800
CHARS_PER_TOKEN = 3.5
#: The rule used for sentences: an end mark with its closing quotes, then a blank; or a line end.
SENTENCE = re.compile(r"[^.!?…。！？\n]*(?:[.!?…。！？]+[\"'”’)\]]*(?=\s|$)|[.!?…。！？]+|\n|$)")
CHUNK_SCHEMA = "video_id string, chunk_type string, chunk_index int, chunk_text string, embedding_input string, chunk_start_ms bigint, chunk_end_ms bigint"


def tokens(text: str) -> int:
    return max(1, math.ceil(len(text) / CHARS_PER_TOKEN)) if text.strip() else 0


def sentences(text: str) -> list[str]:
    out, now = [], ""
    for m in SENTENCE.finditer(text):
        now += m[0]
        if m[0] and (m[0][-1].isspace() or m.end() == len(text) or text[m.end()].isspace()) and now.strip():
            out.append(now.strip())
            now = ""
    if now.strip():
        out.append(now.strip())
    return out or [text]


def word_runs(text: str, target: int) -> list[str]:
    """Words in runs that reach the target, or the hard cap if that is less."""
    words = text.split()
    cap = min(max(target, 1), HARD_CAP)
    out, first, total = [], 0, 0
    for i, w in enumerate(words):
        total += tokens(w)
        if total >= cap:
            out.append(" ".join(words[first : i + 1]))
            first, total = i + 1, 0
    if first < len(words):
        out.append(" ".join(words[first:]))
    return out or [text]


def buckets(sizes: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of units that reach the target; each begins with the longest tail of the one before that fits the overlap."""
    out: list[tuple[int, int]] = []
    upto = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    for i in range(len(sizes)):
        if upto[i + 1] - upto[first] >= target:
            out.append((first, i + 1))
            first = i + 1
            while overlap and first > out[-1][0] and upto[i + 1] - upto[first - 1] <= overlap:
                first -= 1
    if not out or out[-1][1] < len(sizes):
        out.append((first, len(sizes)))
    return out


def split_text(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Whole sentences up to about the target; a sentence over it is cut between words."""
    text = text.strip()
    if not text:
        return []
    if tokens(text) <= target:
        return [text]
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            spans = buckets([tokens(s) for s in run], target, overlap)
            out.extend(" ".join(run[a:b]) for a, b in spans)
            run.clear()

    for s in sentences(text):
        if tokens(s) > target:
            close()
            out.extend(word_runs(s, target))
        else:
            run.append(s)
    close()
    return [p for p in out if p]


def cut_long(start: int, end: int | None, text: str, target: int = TARGET) -> list[tuple[int, int | None, str]]:
    """A segment over the target in pieces, with times spread evenly over its span."""
    if tokens(text) <= target:
        return [(start, end, text)]
    pieces = split_text(text, target, 0) or [text]
    span, n = (start if end is None else end) - start, len(pieces)
    at = [start + span * i // n for i in range(n + 1)]
    return [(at[i], None if end is None else at[i + 1], p) for i, p in enumerate(pieces)]


def clock(ms: int) -> str:
    s = ms // 1000
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def timed_chunks(segments: list[tuple[int, int | None, str]], *, compat: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, text) of chunks of about TARGET tokens with OVERLAP tokens carried over.

    compat drops a last chunk whose segments all start by the end of the chunk
    before, as the reference does even where one of them is new.
    """
    units = [u for s in segments for u in cut_long(*s)]
    if not units:
        return []
    out = []
    for a, b in buckets([tokens(u[2]) for u in units], TARGET, OVERLAP):
        end = units[b - 1][1] if units[b - 1][1] is not None else units[b - 1][0]
        if compat and out and all(u[0] <= out[-1][1] for u in units[a:b]) and b == len(units) and sum(tokens(u[2]) for u in units[a:b]) < TARGET:
            continue
        out.append((units[a][0], end, "\n".join(f"[{clock(u[0])}] {u[2]}" for u in units[a:b])))
    return out


def chunk_segments(segments: DataFrame, videos: DataFrame, *, compat: bool = False) -> DataFrame:
    """Chunks of segments (video_id, kind, seq, start_ms, end_ms, text); kind is body or frame_text.

    videos (video_id, title, channel, platform, tags array) give the embedding input's head.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", kind="stable")
        rows = [(int(s), None if pd.isna(e) else int(e), t) for s, e, t in zip(frame["start_ms"], frame["end_ms"], frame["text"]) if t is not None and not pd.isna(s)]
        video, kind = frame["video_id"].iloc[0], frame["kind"].iloc[0]
        found = timed_chunks(rows, compat=compat)
        return pd.DataFrame({"video_id": video, "chunk_type": kind, "chunk_index": range(len(found)), "chunk_text": [t for *_, t in found], "chunk_start_ms": [s for s, *_ in found], "chunk_end_ms": [e for _, e, _ in found]})

    cut = segments.groupBy("video_id", "kind").applyInPandas(run, "video_id string, chunk_type string, chunk_index int, chunk_text string, chunk_start_ms bigint, chunk_end_ms bigint")
    stamp = F.concat(F.lit("[" ), T.clock_label(F.col("chunk_start_ms")), F.lit(" – "), T.clock_label(F.col("chunk_end_ms")), F.lit("]"))
    head = F.concat_ws("\n", F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Channel: "), F.col("channel")), F.concat(F.lit("Platform: "), F.col("platform")), F.concat(F.lit("Tags: "), F.array_join("tags", ", ")), F.concat(F.lit("Timestamp: "), stamp), F.when(F.col("chunk_type") == "frame_text", F.lit("Source: on-screen text (OCR)")))
    rows = cut.join(videos.select("video_id", "title", "channel", "platform", "tags"), "video_id")
    return rows.select("video_id", "chunk_type", "chunk_index", "chunk_text", F.concat(head, F.lit("\n\n"), F.col("chunk_text")).alias("embedding_input"), "chunk_start_ms", "chunk_end_ms")


def header_chunks(videos: DataFrame) -> DataFrame:
    """One chunk a video: its metadata, which is the embedding input too."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(""))) for label, value in (("Title", F.col("title")), ("Channel", F.col("channel")), ("Platform", F.col("platform")), ("Tags", F.array_join("tags", ", ")), ("Duration", F.col("duration")))]
    text = F.concat_ws("\n", *lines)
    none = F.lit(None).cast("bigint")
    return videos.select("video_id", F.lit("header").alias("chunk_type"), F.lit(0).alias("chunk_index"), text.alias("chunk_text"), text.alias("embedding_input"), none.alias("chunk_start_ms"), none.alias("chunk_end_ms"))


def description_chunks(videos: DataFrame) -> DataFrame:
    """Descriptions of fifty tokens or more with title and channel, in pieces."""
    body = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"^\s+|\s+$", ""))
    rough = F.concat(F.col("title"), F.lit("\n"), F.col("channel"), F.lit("\n\n"), body)
    rows = videos.select("video_id", "title", "channel", body.alias("body"), T.approx_tokens(rough).alias("n")).where((F.col("body") != "") & (F.col("n") >= DESCRIPTION_LEAST))
    split = F.pandas_udf(lambda s: s.map(split_text), "array<string>")
    parts = rows.select("video_id", "title", "channel", F.posexplode(split("body")).alias("chunk_index", "chunk_text"))
    none = F.lit(None).cast("bigint")
    return parts.select("video_id", F.lit("description").alias("chunk_type"), "chunk_index", "chunk_text", F.concat(F.lit("Title: "), F.col("title"), F.lit("\nChannel: "), F.col("channel"), F.lit("\n\n"), F.col("chunk_text")).alias("embedding_input"), none.alias("chunk_start_ms"), none.alias("chunk_end_ms"))


def all_chunks(videos: DataFrame, segments: DataFrame, *, compat: bool = False) -> DataFrame:
    """Header, description, body and frame_text chunks with chunk_id, a hash of their key."""
    rows = header_chunks(videos).unionByName(description_chunks(videos)).unionByName(chunk_segments(segments, videos, compat=compat))
    return rows.withColumn("chunk_id", F.xxhash64("video_id", "chunk_type", "chunk_index"))


def wrap(text: str, width: int = 80) -> list[str]:
    """Words in lines of at most width characters; a longer word has a line of its own."""
    lines: list[str] = []
    for w in text.split():
        if lines and len(lines[-1]) + 1 + len(w) <= width:
            lines[-1] += f" {w}"
        else:
            lines.append(w)
    return lines


def markdown(title: str, texts: list[str], width: int = 80) -> str:
    return f"# {title}\n\n" + "\n".join(wrap(" ".join(texts), width)) + "\n"
