"""What a user calls: a library of videos, chunks and frames with its searches.

Every method returns a DataFrame with the names and defaults that a user of
such a library knows; a query's vector is made on the driver by an embedder.
"""

from __future__ import annotations

import hashlib
import math
import time
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, maintain, retrieval, select
from ..operators.text_index import TextIndex
from ..sources.listing import bundle_files


class Embedder(Protocol):
    """A model of texts: its version, its width, how many tokens it reads, and the vector of one text."""

    version: str
    dim: int
    max_tokens: int

    def embed(self, text: str) -> list[float]: ...


class HashingEmbedder:
    """Signed hashed words, a unit vector: no model file, the same everywhere."""

    version, max_tokens = "hashing@256", 10_000

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim
        self.version = f"hashing@{dim}"

    def embed(self, text: str) -> list[float]:
        out = [0.0] * self.dim
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % self.dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in out))
        return [x / n for x in out] if n else out


def embed_column(df: DataFrame, column: str, embedder: Embedder, *, out: str = "embedding") -> DataFrame:
    """df with the vectors of a text column, by batches of Arrow rows; an embedder with embed_batch gets a batch's texts at once."""
    many = getattr(embedder, "embed_batch", None) or (lambda texts: [embedder.embed(t) for t in texts])
    run = F.pandas_udf(lambda s: pd.Series(many([t or "" for t in s]), index=s.index), "array<float>")
    return df.withColumn(out, run(F.col(column))).withColumn("model_version", F.lit(embedder.version)).withColumn("embedding_dim", F.lit(embedder.dim))


def truncated(ids: list[int], limit: int = 256) -> list[int]:
    """At most limit ids, the last of all among them: an encoder's end mark stays."""
    return ids if len(ids) <= limit else [*ids[: limit - 1], ids[-1]]


def too_long(chunks: DataFrame, embedder: Embedder, *, text: str = "embedding_input") -> DataFrame:
    """Chunks that the embedder would cut."""
    return chunks.where(T.approx_tokens(F.col(text)) > embedder.max_tokens)


@dataclass
class Library:
    """index answers keyword queries where it is given (the scan of all chunks does where not); notes (video_id, path, raw) and
    files (folder, name, path), as parse_notes and list_files give them, serve whole transcripts and a video's files."""

    videos: DataFrame
    chunks: DataFrame
    frames: DataFrame
    embedder: Embedder
    index: TextIndex | None = None
    notes: DataFrame | None = None
    files: DataFrame | None = None

    def synced(self) -> Library:
        """With an index that has the chunks as they are now; one whose files are unchanged is not read."""
        if self.index is not None:
            self.index = self.index.sync(self.chunks, kind="platform")
        return self

    def _sparse(self, query: str, platform: str | None) -> DataFrame:
        if self.index is not None:
            return self.index.search(query, kind=platform)
        return retrieval.sparse_top_k(self.chunks, query, where=F.col("platform") == platform if platform is not None else None)

    def search_response(self, query: str, k: int = 15, platform: str | None = None, since_iso: str | None = None) -> dict:
        """search as a response: results, the query, how many chunks were searched, and milliseconds by step.

        A query that the embedder fails on, or has no vector for, is answered by
        keywords, with a note; an unknown platform or a blank query is an error.
        """
        if not query.strip():
            return {"error": "the query is blank", "query": query, "results": []}
        if platform is not None and platform not in T.PREFIXES and self.videos.where(F.col("platform") == platform).isEmpty():
            return {"error": f"no such platform: {platform}", "query": query, "results": []}
        clock, notes, ms = time.perf_counter, [], {}
        begun = at = clock()
        self.synced()
        ms["sync"], at = int((clock() - at) * 1000), clock()
        try:
            vector = self.embedder.embed(query[:10_000])
        except RuntimeError as e:
            vector, notes = [], [f"keyword search only: {e}"]
        if not notes and not any(vector):
            notes = ["keyword search only: the query has no vector"]
        ms["embed"], at = int((clock() - at) * 1000), clock()
        rows = [r.asDict() for r in self._found(query, vector, k, platform, since_iso).collect()]
        total = self.index.size()[0] if self.index is not None else self.chunks.count()
        ms |= {"retrieve": int((clock() - at) * 1000), "total": int((clock() - begun) * 1000)}
        return {"results": rows, "query": query, "sub_queries": [], "total_chunks_searched": total, "notes": notes, "ms": ms}

    def search(self, query: str, k: int = 15, platform: str | None = None, since_iso: str | None = None) -> DataFrame:
        """Dense and sparse lists fused, two hits a video, then the since filter; keyword hits alone where the query has no vector."""
        return self._found(query, self.embedder.embed(query[:10_000]), k, platform, since_iso)

    def _found(self, query: str, vector: list[float], k: int, platform: str | None, since_iso: str | None) -> DataFrame:
        query, k, lists = query[:10_000], retrieval.clamp_k(k), []
        if any(vector):
            dense = retrieval.dense_top_k(self.chunks, vector, platform=platform, model_version=self.embedder.version)
            lists.append(("dense", dense.select("chunk_id", "rank")))
        lists.append(("sparse", self._sparse(query, platform).select("chunk_id", "rank")))
        hits = retrieval.hybrid_search(self.chunks, lists, top_k=k)
        since = None
        if since_iso is not None:
            stamp = pd.to_datetime(since_iso, utc=True, errors="coerce")
            since = None if pd.isna(stamp) else int(stamp.timestamp() * 1000)
        rows = retrieval.hydrate(hits, self.chunks.drop("platform"), self.videos, since_ms=since)
        rows = asof.frames_for_chunks(rows, self.frames.select("video_id", "frame_id", "frame_ms"))
        return rows.select("place", "chunk_id", "video_id", "title", "channel", "platform", "url", "chunk_type", "chunk_text", "label", "score", "frame_ids").orderBy("place")

    def search_frames(self, query: str, k: int = 10, platform: str | None = None) -> DataFrame:
        return retrieval.search_frames(self.frames, self.videos, self.embedder.embed(query[:10_000]), k, platform=platform)

    def find_similar(self, video_id: str, k: int = 10) -> DataFrame:
        return retrieval.find_similar(self.chunks, video_id, k, model_version=self.embedder.version, dim=self.embedder.dim).join(self.videos.select("video_id", "title"), "video_id").orderBy(F.col("score").desc(), "video_id")

    def list_videos(self, platform: str | None = None, channel: str | None = None, limit: int = 100) -> DataFrame:
        return select.list_videos(self.videos, platform=platform, channel=channel, limit=limit)

    def get_video(self, video_id: str) -> DataFrame:
        """A video with the times of its frames, and where files are known with its folder's note and files."""
        own = self.videos.where(F.col("video_id") == video_id)
        frames = self.frames.where(F.col("video_id") == video_id).groupBy("video_id").agg(F.array_sort(F.collect_list("frame_ms")).alias("frames"))
        out = own.join(frames, "video_id", "left")
        if self.files is None or self.notes is None:
            return out
        note = self.notes.where(F.col("video_id") == video_id).groupBy("video_id").agg(F.min("path").alias("video_md_path"))
        folder = F.element_at(F.split("video_md_path", "/"), -2)
        held = bundle_files(self.files).select(F.col("folder").alias("_folder"), "files")
        return out.join(note, "video_id", "left").join(held, folder == F.col("_folder"), "left").drop("_folder")

    def get_transcript(self, video_id: str) -> DataFrame:
        """The note's text below its frontmatter (video_id, title, transcript, video_md_path) where notes are given.

        Without notes, lines of the body chunks in order; overlap shows twice, as chunks hold it.
        """
        if self.notes is None:
            return self.chunks.where((F.col("video_id") == video_id) & (F.col("chunk_type") == "body")).orderBy("chunk_index").select("video_id", "chunk_index", "chunk_start_ms", "chunk_text")
        own = self.notes.where(F.col("video_id") == video_id).groupBy("video_id").agg(F.min_by(F.struct("path", "raw"), "path").alias("n"))
        text = T.without_frontmatter(F.regexp_replace(F.col("n.raw"), r"\r", ""))
        return own.join(self.videos.select("video_id", "title"), "video_id").select("video_id", "title", F.regexp_replace(text, r"^\s+|\s+$", "").alias("transcript"), F.col("n.path").alias("video_md_path"))

    def find_transcript(self, identifier: str) -> DataFrame:
        """get_transcript of the video that an address, an id or a path names; none where nothing does."""
        ids = self.videos.select((-F.col("date_saved")).alias("position"), "video_id", F.regexp_replace("video_id", "^[^:]*:", "").alias("raw_id"), "url")
        hit = select.resolve_identifier(ids, identifier).first()
        return self.get_transcript(hit["video_id"] if hit else "")

    def view_frames(self, video_id: str, frame_ms: list[int] | None = None, max_frames: int = 6) -> DataFrame:
        """Frames nearest the asked times, or an even sample, at most max_frames (1 to 12), by time."""
        own = self.frames.where(F.col("video_id") == video_id).select("video_id", "frame_id", "frame_ms", "frame_path")
        cap = max(1, min(int(max_frames), 12))
        if not frame_ms:
            return asof.even_sample(own, ["video_id"], [F.col("frame_ms")], cap).orderBy("frame_ms")
        asked = own.sparkSession.createDataFrame([(video_id, i, int(ms)) for i, ms in enumerate(frame_ms)], "video_id string, place int, at_ms bigint")
        return asof.frames_for_times(asked, own, cap).join(own.select("frame_id", "frame_path"), "frame_id").orderBy("frame_ms")

    def stats(self) -> DataFrame:
        return maintain.table_counts({"videos": self.videos, "chunks": self.chunks, "frames": self.frames})
