"""Dense and sparse retrieval, fusion, caps and hydration."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import text as T
from ..functions import vectors as V

#: BM25 parameters, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
POOL, TOP_K, PER_VIDEO = 50, 15, 2
MOST = 50
#: Rows of hits that may be broadcast: no top-k result is larger, whatever k is asked for.
HIT_ROWS = 10_000


def clamp_k(k: int, most: int = MOST) -> int:
    return max(1, min(int(k), most))


def distance(vector: Column, query: list[float] | Column, metric: str = "cosine") -> Column:
    q = query if isinstance(query, Column) else F.lit([float(x) for x in query])
    if metric == "cosine":
        return 1 - V.cosine(vector, q)
    if metric == "l2":
        return V.l2(vector, q)
    if metric == "dot":
        return 1 - V.dot(vector, q)
    raise ValueError(f"no such metric: {metric}")


def distance_of(query: list[float], metric: str = "cosine"):
    """distance of a vector column to one query, by batches."""
    if metric not in ("cosine", "l2", "dot"):
        raise ValueError(f"no such metric: {metric}")
    return V.distance_to([float(x) for x in query], metric)


def dense_top_k(
    df: DataFrame, query: list[float], k: int = POOL, *, id: str = "chunk_id", vector: str = "embedding", metric: str = "cosine", platform: str | None = None, chunk_types: list[str] | None = None, model_version: str | None = None, prefilter: bool = False
) -> DataFrame:
    """(id, distance, rank) of the nearest vectors.

    Partition predicates come before the cut; the model's version is compared
    after it, so that it may leave fewer than k, unless prefilter is set.  A vector
    with a null or NaN component is near nothing.  Each task keeps its own k
    nearest: nothing is shuffled but those.
    """
    if platform is not None:
        df = df.where(F.col("platform") == platform)
    if chunk_types is not None:
        df = df.where(F.col("chunk_type").isin(chunk_types))
    if model_version is not None and prefilter:
        df = df.where(F.col("model_version") == model_version)
    df = df.where(V.width_is(F.col(vector), len(query)))
    keep = [id, "model_version"] if model_version is not None else [id]
    k = max(1, min(int(k), HIT_ROWS))
    top = df.select(*keep, distance_of(query, metric)(F.col(vector)).alias("distance")).where(F.col("distance").isNotNull()).orderBy("distance", id).limit(k)
    if model_version is not None:
        top = top.where(F.col("model_version") == model_version).drop("model_version")
    return ranked(top, [F.col("distance"), F.col(id)])


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows of a bounded result with their place, from 1 on."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def postings(df: DataFrame, *, id: str = "chunk_id", text: str = "chunk_text") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, doc_len); terms are lower-case runs of letters, marks and numbers."""
    rows = df.select(id, T.search_words(F.col(text)).alias("tokens"))
    terms = rows.select(id, F.explode("tokens").alias("term")).groupBy("term", id).agg(F.count("*").alias("tf"))
    return terms, rows.select(id, F.size("tokens").alias("doc_len"))


def sparse_top_k(df: DataFrame, query: str, k: int = POOL, *, id: str = "chunk_id", text: str = "chunk_text", where: Column | None = None) -> DataFrame:
    """(id, score, rank) by BM25, smaller is better; any of the query's words may match, a repeated one counts again.

    Statistics are those of all rows; where narrows what may be returned.  One
    pass over the texts gives lengths and the counts of the query's words only,
    so no postings of other words are made or shuffled.
    """
    words = query_words(query)
    spark = df.sparkSession
    if not words:
        return spark.createDataFrame([], StructType([df.schema[id], StructField("score", DoubleType()), StructField("rank", IntegerType())]))
    distinct = sorted(set(words))
    tokens = T.search_words(F.coalesce(F.col(text), F.lit("")))
    counts = [F.size(F.filter("tokens", _equals(w))).alias(f"_{i}") for i, w in enumerate(distinct)]
    flag = (where if where is not None else F.lit(True)).alias("_in")
    rows = df.select(id, flag, tokens.alias("tokens")).select(id, "_in", F.size("tokens").alias("_len"), *counts)
    stats = rows.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.sum((F.col(f"_{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(distinct))))
    # One row: the cheapest of broadcasts.
    both = rows.where("_in").where(" or ".join(f"_{i} > 0" for i in range(len(distinct)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i, w in enumerate(distinct):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        tf = F.col(f"_{i}")
        score = score - words.count(w) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("avg")))
    top = both.select(id, score.alias("score")).orderBy("score", id).limit(max(1, min(int(k), HIT_ROWS)))
    return ranked(top, [F.col("score"), F.col(id)])


def _equals(word: str):
    return lambda t: t == F.lit(word)


def query_words(query: str) -> list[str]:
    """The query's words, by the rule that texts are cut by."""
    return regex.findall(T.SEARCH_WORD, query.lower())


def rrf(lists: list[tuple[str, DataFrame]], *, id: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists (source, (id, rank)): id, score, dense_rank, sparse_rank, first_list, first_rank."""
    union: DataFrame | None = None
    for place, (source, df) in enumerate(lists):
        part = df.select(F.col(id), F.col("rank"), F.lit(source).alias("source"), F.lit(place).alias("place"))
        union = part if union is None else union.unionByName(part)
    if union is None:
        raise ValueError("no list to fuse")
    best = lambda s: F.min(F.when(F.col("source") == s, F.col("rank")))
    first = F.min(F.struct("place", "rank"))
    fused = union.groupBy(id).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), best("dense").alias("dense_rank"), best("sparse").alias("sparse_rank"), first.alias("first"))
    return fused.select(id, "score", "dense_rank", "sparse_rank", F.col("first.place").alias("first_list"), F.col("first.rank").alias("first_rank"))


def fused_order(id: str) -> list[Column]:
    return [F.col("score").desc(), F.col("first_list"), F.col("first_rank"), F.col(id)]


def cap_per_group(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each group, best first; Spark prunes each task's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def dedupe_per_video(hits: DataFrame, chunks: DataFrame, *, id: str = "chunk_id", video: str = "video_id", most: int = PER_VIDEO) -> DataFrame:
    """Hits with their video, at most two of each; hits without a chunk go."""
    known = chunks.select(id, video).join(F.broadcast(hits), id)  # hits are a bounded top-k
    return cap_per_group(known, video, fused_order(id), most)


def hybrid_search(chunks: DataFrame, lists: list[tuple[str, DataFrame]], *, top_k: int = TOP_K, id: str = "chunk_id", video: str = "video_id", most: int = PER_VIDEO) -> DataFrame:
    """Fuse, cap, cut - in this order; ranked."""
    capped = dedupe_per_video(rrf(lists, id=id), chunks, id=id, video=video, most=most)
    return ranked(capped.orderBy(*fused_order(id)).limit(top_k), fused_order(id), "place")


def find_similar(chunks: DataFrame, anchor: str, k: int = 10, *, model_version: str, dim: int, metric: str = "cosine") -> DataFrame:
    """Videos whose header is near the mean of the anchor's body chunks: video_id, chunk_id, score; none without body chunks."""
    k = clamp_k(k)
    own = chunks.where((F.col("video_id") == anchor) & (F.col("chunk_type") == "body") & (F.col("model_version") == model_version))
    center = V.centroid(own, ["video_id"], "embedding", dim).select(F.col("embedding").alias("_q"))
    heads = chunks.where((F.col("chunk_type") == "header") & V.width_is(F.col("embedding"), dim))
    pool = heads.join(F.broadcast(center)).select("chunk_id", "video_id", "model_version", distance(F.col("embedding"), F.col("_q"), metric).alias("distance")).orderBy("distance", "chunk_id").limit(max(3 * k, 20))
    near = pool.where((F.col("video_id") != anchor) & (F.col("model_version") == model_version))
    best = cap_per_group(near, "video_id", [F.col("distance"), F.col("chunk_id")], 1)
    return best.orderBy("distance", "chunk_id").limit(k).select("video_id", "chunk_id", (1 - F.col("distance")).alias("score"))


def search_frames(frames: DataFrame, videos: DataFrame, query: list[float], k: int = 10, *, platform: str | None = None, metric: str = "cosine") -> DataFrame:
    """The nearest frames, at most three of a video: frame_id, video_id, frame_ms, frame_label, score."""
    k = clamp_k(k)
    pool = dense_top_k(frames, query, max(5 * k, 30), id="frame_id", metric=metric, platform=platform)
    rows = frames.select("frame_id", "video_id", "frame_ms").join(F.broadcast(pool), "frame_id").join(videos.select("video_id", "title"), "video_id")
    best = cap_per_group(rows, "video_id", [F.col("distance"), F.col("frame_id")], 3).orderBy("distance", "frame_id").limit(k)
    return best.select("frame_id", "video_id", "title", "frame_ms", T.bracket_label(F.col("frame_ms")).alias("frame_label"), (1 - F.col("distance")).alias("score"))


def hydrate(hits: DataFrame, chunks: DataFrame, videos: DataFrame, *, since_ms: int | None = None) -> DataFrame:
    """Hits with their chunk and video; since_ms filters after the cut, so fewer than k may be left."""
    rows = chunks.drop("video_id_").join(F.broadcast(hits.select("chunk_id", F.round("score", 6).alias("score"), "place")), "chunk_id").join(videos, "video_id")
    if since_ms is not None:
        rows = rows.where(F.col("date_saved") >= since_ms)
    return rows.withColumn("label", T.bracket_label(F.col("chunk_start_ms")))


def hit_rate(ranks: DataFrame, at: list[int]) -> DataFrame:
    """Share of queries whose right answer is among the first k: one row; rank is null where it was not found."""
    return ranks.agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"hit_at_{k}") for k in at))
