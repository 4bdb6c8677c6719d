"""Registered queries over the driver's tables, each beside its DuckDB SQL.

documents stand for videos and chunks (doc_id, lang as platform, source as
channel), embeddings for chunk and frame vectors (vec_id, label as parent),
conversations for segments, events for timelines, pages for scraped HTML and
benchmark for queries.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import asof, chunking, maintain, retrieval, scan, select, text_index, vector_index, windows
from ..sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM = 64
WORDS = "the le der of hation the"
LISTED = ("the", "le", "der", "of", "hation")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def vector_of(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    """The query's vector: one row."""
    row = read(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * DIM


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("video_id"), F.col("lang").alias("platform"), "source", F.col("text").alias("chunk_text"), "n_chars")


# --- retrieval ---------------------------------------------------------------

_DENSE = """
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM embeddings, q {where}),
top AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT {k})"""


@query(_DENSE.format(where="", k=50) + " SELECT vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM top")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieval.dense_top_k(read(spark, sf, "embeddings"), vector_of(spark, sf, 0), 50, id="vec_id")
    return top.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("place"))


@query(_DENSE.format(where="WHERE label IN (1, 3, 5)", k=20) + " SELECT vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM top")
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").where(F.col("label").isin(1, 3, 5))
    top = retrieval.dense_top_k(rows, vector_of(spark, sf, 0), 20, id="vec_id")
    return top.select("vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("place"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
d AS (SELECT vec_id, CAST(label AS VARCHAR) AS model_version, list_distance(embedding::DOUBLE[], e) AS distance FROM embeddings, q),
top AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 50)
SELECT vec_id, round(distance, 6) AS distance FROM top WHERE model_version = '1'""")
def dense_then_model_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").withColumn("model_version", F.col("label").cast("string"))
    top = retrieval.dense_top_k(rows, vector_of(spark, sf, 0), 50, id="vec_id", metric="l2", model_version="1")
    return top.select("vec_id", F.round("distance", 6).alias("distance"))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
_BM25 = f"""
WITH tok AS (SELECT doc_id, lang, source, {_TOKENS} AS ts FROM documents),
len AS (SELECT doc_id, lang, source, coalesce(len(ts), 0) AS dl FROM tok),
stat AS (SELECT count(*) AS n, avg(dl) AS adl FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) WHERE term IN ('the', 'le', 'der', 'of', 'hation') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * CASE WHEN term = 'the' THEN 2 ELSE 1 END AS w FROM df, stat),
bm AS (SELECT doc_id, lang, source, -sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / adl))) AS score FROM post JOIN idf USING (term) JOIN len USING (doc_id), stat GROUP BY ALL)"""


_TOP50 = _BM25 + ", top AS (SELECT * FROM bm ORDER BY score, doc_id LIMIT 50) SELECT doc_id, round(score, 6) AS score FROM top"


def index_of(spark: SparkSession, sf: str) -> text_index.TextIndex:
    """The stored index of the documents, made or brought up to date where their files changed."""
    return text_index.open_index(chunks(spark, sf), f"{shared_folder(spark)}/bm25-index-{zlib.crc32(sf.encode()):08x}", kind="platform")


def vectors_of(spark: SparkSession, sf: str) -> vector_index.VectorIndex:
    """The stored vectors in cells."""
    path = f"{shared_folder(spark)}/vector-index-{zlib.crc32(sf.encode()):08x}"
    return vector_index.open_vectors(read(spark, sf, "embeddings"), path, id="vec_id", vector="embedding", dim=DIM, keep=("label",))


@query(_TOP50)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).search(WORDS, 50).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_TOP50)
def bm25_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same without an index, by one pass over the texts."""
    top = retrieval.sparse_top_k(read(spark, sf, "documents"), WORDS, 50, id="doc_id", text="text")
    return top.select("doc_id", F.round("score", 6).alias("score"))


@query(_TOP50)
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same from an index that came to hold all documents by three syncs and a compaction.

    At first some are missing, some have another text and some are there that
    go; then all are there, some still with that text; then all as they are.
    """
    rows, path = chunks(spark, sf), f"{shared_folder(spark)}/bm25-steps-{uuid.uuid4().hex}"
    old = rows.withColumn("chunk_text", F.when(F.col("chunk_id") % 5 == 0, F.lit("the old words of it")).otherwise(F.col("chunk_text")))
    gone = rows.where("chunk_id % 7 = 0").withColumn("chunk_id", -1 - F.col("chunk_id"))
    for step in (old.where("chunk_id % 3 > 0").unionByName(gone), old, rows):
        index = text_index.TextIndex(spark, path).sync(step, kind="platform")
    return index.compact().search(WORDS, 50).select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_BM25 + ", top AS (SELECT * FROM bm WHERE lang = 'fr' ORDER BY score, doc_id LIMIT 50) SELECT doc_id, round(score, 6) AS score FROM top")
def bm25_topk_platform(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf).search(WORDS, 50, kind="fr").select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    terms, _ = retrieval.postings(read(spark, sf, "documents"), id="doc_id", text="text")
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_HYBRID = _BM25 + """,
q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
dd AS (SELECT vec_id AS doc_id, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM embeddings, q),
dense AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS r, 'dense' AS s, 0 AS p FROM (SELECT * FROM dd ORDER BY distance, doc_id LIMIT 50)),
sparse AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) AS r, 'sparse' AS s, 1 AS p FROM (SELECT * FROM bm ORDER BY score, doc_id LIMIT 50)),
fused AS (SELECT doc_id, sum(1.0 / (60 + r)) AS score, min(r) FILTER (s = 'dense') AS dense_rank, min(r) FILTER (s = 'sparse') AS sparse_rank, min(p) AS p, arg_min(r, p) AS fr FROM (SELECT * FROM dense UNION ALL SELECT * FROM sparse) GROUP BY doc_id)"""
_CAPPED = _HYBRID + """,
known AS (SELECT f.*, d.source || '/' || d.lang AS video_id, d.n_chars FROM fused f JOIN documents d USING (doc_id)),
capped AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, p, fr, doc_id) AS n FROM known),
top AS (SELECT * FROM capped WHERE n <= 2 ORDER BY score DESC, p, fr, doc_id LIMIT 15)"""


def _lists(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    dense = retrieval.dense_top_k(read(spark, sf, "embeddings"), vector_of(spark, sf, 0), 50, id="vec_id").withColumnRenamed("vec_id", "chunk_id")
    sparse = index_of(spark, sf).search(WORDS, 50)
    return [("dense", dense.select("chunk_id", "rank")), ("sparse", sparse.select("chunk_id", "rank"))]


@query(_HYBRID + " SELECT doc_id AS chunk_id, round(score, 9) AS score, dense_rank, sparse_rank FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    fused = retrieval.rrf(_lists(spark, sf))
    return fused.select("chunk_id", F.round("score", 9).alias("score"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"))


@query(_CAPPED + " SELECT doc_id AS chunk_id, video_id, round(score, 9) AS score, dense_rank, sparse_rank, row_number() OVER (ORDER BY score DESC, p, fr, doc_id) AS place FROM top")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieval.hybrid_search(chunks(spark, sf), _lists(spark, sf))
    return top.select("chunk_id", "video_id", F.round("score", 9).alias("score"), F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.col("place").cast("long").alias("place"))


@query(_CAPPED + " SELECT doc_id AS chunk_id, video_id, n_chars, round(score, 6) AS score FROM top WHERE n_chars >= 1000")
def hybrid_since(spark: SparkSession, sf: str) -> DataFrame:
    """The since filter comes after the cut; n_chars stands for the date."""
    base = chunks(spark, sf)
    top = retrieval.hybrid_search(base, _lists(spark, sf))
    videos = base.select("video_id").distinct()
    rows = retrieval.hydrate(top, base.withColumn("chunk_start_ms", F.lit(None).cast("long")).withColumn("date_saved", F.col("n_chars")), videos, since_ms=1000)
    return rows.select("chunk_id", "video_id", "n_chars", "score")


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7),
d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM embeddings, q),
pool AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 50),
c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS n FROM pool)
SELECT vec_id AS frame_id, label AS video_id, round(1 - distance, 6) AS score, '[' || (vec_id // 60)::VARCHAR || ':' || lpad((vec_id % 60)::VARCHAR, 2, '0') || ']' AS frame_label FROM c WHERE n <= 3 ORDER BY distance, vec_id LIMIT 10""")
def frames_capped(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").alias("video_id"), (F.col("vec_id") * 1000).alias("frame_ms"), "embedding")
    videos = rows.select("video_id", F.concat(F.lit("video "), F.col("video_id").cast("string")).alias("title")).distinct()
    top = retrieval.search_frames(rows, videos, vector_of(spark, sf, 7), 10)
    return top.select("frame_id", "video_id", F.round("score", 6).alias("score"), "frame_label")


@query("""
WITH own AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label = 2 AND vec_id % 2 = 1),
m AS (SELECT i, avg(x) AS x FROM own GROUP BY i), c AS (SELECT list(x ORDER BY i) AS e FROM m),
d AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], e) AS distance FROM embeddings, c WHERE vec_id % 2 = 0),
pool AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 30),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS n FROM pool WHERE label <> 2)
SELECT 'v' || label::VARCHAR AS video_id, vec_id AS chunk_id, round(1 - distance, 6) AS score FROM b WHERE n = 1 ORDER BY distance, vec_id LIMIT 10""")
def find_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Odd vectors stand for body chunks, even ones for headers."""
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), F.when(F.col("vec_id") % 2 == 1, "body").otherwise("header").alias("chunk_type"), F.lit("m").alias("model_version"), "embedding")
    return retrieval.find_similar(rows, "v2", 10, model_version="m", dim=DIM).select("video_id", "chunk_id", F.round("score", 6).alias("score"))


@query("""
WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, i - 1 AS pos, round(x / n, 6) AS value FROM m JOIN n USING (label)""")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = V.centroid(read(spark, sf, "embeddings"), ["label"], "embedding", DIM)
    return c.select("label", F.posexplode("embedding").alias("pos", "value")).select("label", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query("""
WITH b AS (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i) ELSE 0::HUGEINT END)) AS h, embedding[64] > 0 AS top FROM embeddings),
p AS (SELECT vec_id, label, CAST(h - CASE WHEN top THEN 9223372036854775808::HUGEINT ELSE 0 END AS BIGINT) AS phash FROM b)
SELECT vec_id, phash, bit_count(xor(phash, lag(phash) OVER (PARTITION BY label ORDER BY vec_id)))::INT AS step FROM p""")
def phash_steps(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select("vec_id", "label", V.sign_bits(F.col("embedding")).alias("phash"))
    return rows.select("vec_id", "phash", V.hamming(F.col("phash"), F.lag("phash").over(Window.partitionBy("label").orderBy("vec_id"))).alias("step"))


@query("""
WITH RECURSIVE o AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, n, vec_id, e AS last, true AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.label, o.n, o.vec_id, CASE WHEN list_distance(o.e, f.last) >= 1.4 THEN o.e ELSE f.last END, list_distance(o.e, f.last) >= 1.4 FROM f JOIN o ON o.label = f.label AND o.n = f.n + 1)
SELECT vec_id, label FROM f WHERE kept""")
def near_duplicate_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return windows.drop_near(rows, "label", "vec_id", "embedding", 1.4).select("vec_id", "label")


@query("""
WITH s AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r, a.label = b.label AS same
 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
f AS (SELECT vec_id, min(r) FILTER (same) AS r FROM s GROUP BY vec_id)
SELECT round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 9) AS hit_at_1, round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 9) AS hit_at_5 FROM f""")
def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Queries are the vectors whose id 50 divides, against all; a hit shares the label."""
    asked = read(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0)
    near = vectors_of(spark, sf).nearest_join(asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 5, keep=("label",))
    placed = asked.select(F.col("vec_id").alias("query"), F.col("label").alias("own")).join(near, "query", "left").groupBy("query").agg(F.min(F.when(F.col("own") == F.col("label"), F.col("place"))).alias("rank"))
    return retrieval.hit_rate(placed, [1, 5]).select(F.round("hit_at_1", 9).alias("hit_at_1"), F.round("hit_at_5", 9).alias("hit_at_5"))


@query(_DENSE.format(where="WHERE label IN (1, 3, 5)", k=50) + " SELECT vec_id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, vec_id) AS place FROM top")
def dense_topk_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors of three labels, from the stored cells that can hold them."""
    top = vectors_of(spark, sf).search(vector_of(spark, sf, 0), 50, where=F.col("label").isin(1, 3, 5), id="vec_id")
    return top.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("long").alias("place"))


# --- listing and keyword search ------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def list_recent(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.col("lang").alias("platform"), F.col("n_chars").alias("date_saved"))
    return select.list_videos(rows).select(F.col("video_id").alias("doc_id"), F.col("platform").alias("lang"), F.col("date_saved").alias("n_chars"))


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 1000")
def list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.col("lang").alias("platform"), F.col("source").alias("channel"), F.col("n_chars").alias("date_saved"))
    return select.list_videos(rows, platform="en", channel="src3", limit=5000).select(F.col("video_id").alias("doc_id"), F.col("date_saved").alias("n_chars"))


@query("""
WITH h AS (SELECT doc_id, n_chars, lower(concat_ws(' ', text, source, lang)) AS hay FROM documents),
s AS (SELECT doc_id, n_chars, CASE WHEN starts_with(hay, 'the') OR contains(hay, ' the') THEN 2 ELSE 1 END + CASE WHEN starts_with(hay, 'tion') OR contains(hay, ' tion') THEN 2 ELSE 1 END + CASE WHEN starts_with(hay, 'src1') OR contains(hay, ' src1') THEN 2 ELSE 1 END AS score FROM h WHERE contains(hay, 'the') AND contains(hay, 'tion') AND contains(hay, 'src1'))
SELECT doc_id, score, n_chars FROM s ORDER BY score DESC, n_chars DESC, doc_id LIMIT 25""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    top = select.keyword_search(read(spark, sf, "documents"), "The, TION src1 x", 25, id="doc_id", fields=("text", "source", "lang"), date="n_chars")
    return top.select("doc_id", "score", "n_chars")


# --- as-of ---------------------------------------------------------------------

_SIDES = """
WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
r AS (SELECT event_id AS rid, user_id AS u, epoch_us(ts) AS rt FROM events WHERE event_type = 'view')"""
_PICK = _SIDES + " SELECT event_id, match_id FROM (SELECT l.event_id, r.rid AS match_id, row_number() OVER (PARTITION BY l.event_id ORDER BY {order}) AS n FROM l LEFT JOIN r ON l.user_id = r.u) WHERE n = 1"


def _event_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    return left, e.where("event_type = 'view'").select(F.col("event_id").alias("rid"), "user_id", F.col("t").alias("rt"))


_ASOF = {"key": "user_id", "left_time": "t", "right_time": "rt", "right_id": "rid"}


@query(_PICK.format(order="abs(rt - t) NULLS LAST, rt DESC, rid"))
def nearest_event_later(spark: SparkSession, sf: str) -> DataFrame:
    return asof.nearest(*_event_sides(spark, sf), **_ASOF).select("event_id", "match_id")


@query(_PICK.format(order="abs(rt - t) NULLS LAST, rt, rid"))
def nearest_event_earlier(spark: SparkSession, sf: str) -> DataFrame:
    return asof.nearest(*_event_sides(spark, sf), tie="earlier", **_ASOF).select("event_id", "match_id")


@query(_PICK.format(order="CASE WHEN rt IS NULL THEN 2 WHEN rt <= t THEN 0 ELSE 1 END, abs(rt - t), rid"))
def backward_event(spark: SparkSession, sf: str) -> DataFrame:
    return asof.backward(*_event_sides(spark, sf), **_ASOF).select("event_id", "match_id")


@query(_PICK.format(order="CASE WHEN rt IS NULL THEN 2 WHEN rt >= t THEN 0 ELSE 1 END, abs(rt - t), rid"))
def forward_event(spark: SparkSession, sf: str) -> DataFrame:
    return asof.forward(*_event_sides(spark, sf), **_ASOF).select("event_id", "match_id")


@query(_PICK.format(order="abs(rt - t) NULLS LAST, rt DESC, rid"))
def nearest_event_spread(spark: SparkSession, sf: str) -> DataFrame:
    """As nearest_event_later, with a key's rows over as many tasks as they ask for."""
    return asof.nearest(*_event_sides(spark, sf), **_ASOF, spread=True).select("event_id", "match_id")


# --- windows -------------------------------------------------------------------


@query("SELECT conv_id, turn, length(text) AS n, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS end_turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_chars FROM conversations")
def segment_lead(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    rows = windows.segment_ends(rows, ["conv_id"], "turn", "turn").withColumnRenamed("end_ms", "end_turn")
    return windows.running_before(rows, ["conv_id"], ["turn"], "n", name="before_chars")


@query("SELECT event_type, event_id, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, sum(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id)::BIGINT AS upto FROM events")
def events_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbour and running sum within a few large keys, over all tasks."""
    rows = read(spark, sf, "events").select("event_type", "event_id", "ts", "user_id")
    order = [F.col("ts"), F.col("event_id")]
    summed = scan.scanned(rows, "event_type", order, sums=("user_id",), name="sums").withColumnRenamed("upto_user_id", "upto")
    return scan.previous(summed, "event_type", order, "event_id", "before").select("event_type", "event_id", "before", "upto")


@query("""
WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, user_id, event_type FROM p WHERE b IS NULL OR b <> event_type""")
def islands_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return windows.drop_held(read(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return windows.latest_wins(read(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "value")


@query("SELECT event_id, user_id, (n - 1) // 25 AS batch, (n - 1) % 4 AS worker FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)")
def batches_and_workers(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    rows = windows.round_robin(windows.batches(read(spark, sf, "events"), order, 25, ["user_id"]), order, 4, ["user_id"])
    return rows.select("event_id", "user_id", F.col("batch").cast("long").alias("batch"), F.col("worker").cast("long").alias("worker"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT DISTINCT user_id, n, CAST(round_even(k * (n - 1) / 5.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT user_id, n FROM o), range(0, 6) t(k))
SELECT event_id, o.user_id FROM o LEFT JOIN p ON o.user_id = p.user_id AND o.i = p.i WHERE o.n <= 6 OR p.i IS NOT NULL""")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return asof.even_sample(read(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 6).select("event_id", "user_id")


@query("""
WITH b AS (SELECT doc_id, (n_chars / 100.0)::DOUBLE AS d FROM documents), c AS (SELECT doc_id, d, least(12, greatest(1, floor(d * 0.5)))::BIGINT AS n FROM b)
SELECT doc_id, i AS pos, round(i * d / n, 6) AS at FROM c, range(0, 12) t(i) WHERE d > 0 AND i < n""")
def frame_times(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("n_chars") / F.lit(100.0)
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(windows.frame_times(d, 12, 0.5)).alias("pos", "at"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("at", 6).alias("at"))


# --- maintenance ---------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def delta_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.missing(read(spark, sf, "documents").select("doc_id"), read(spark, sf, "embeddings"), "doc_id", "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.missing(read(spark, sf, "embeddings").select("vec_id", "label"), read(spark, sf, "labels"), "vec_id", "doc_id")


@query("SELECT d.doc_id, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR d.n_chars > l.quality * 2000")
def stale_diff(spark: SparkSession, sf: str) -> DataFrame:
    index = read(spark, sf, "labels").select("doc_id", (F.col("quality") * 2000).alias("indexed_at"))
    return maintain.stale(read(spark, sf, "documents").select("doc_id", "n_chars"), index, key="doc_id", changed="n_chars", done="indexed_at")


@query("SELECT count(DISTINCT d.source) AS videos, count(*) AS chunks FROM documents d WHERE d.lang <> 'en' AND d.source IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND n_chars > 3000)")
def migration_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select(F.col("source").alias("video_id"), F.col("lang").alias("model_version"))
    videos = read(spark, sf, "documents").where("doc_id % 7 = 0 AND n_chars > 3000").select(F.col("source").alias("video_id")).distinct()  # other sources' chunks are orphans
    return maintain.migration_scope(rows, videos, "en")


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.table_counts({t: read(spark, sf, t) for t in ("documents", "embeddings", "events", "conversations")})


@query("SELECT coalesce(max(doc_id), 0) AS max_id, count(*) AS n FROM documents")
def change_probe(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.change_probe(read(spark, sf, "documents"), "doc_id", "text").select("max_id", "n")


@query("SELECT c.c_custkey AS video_id, coalesce(o.n, 0) AS chunk_count, o.m AS model_version FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS m FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey")
def index_state(spark: SparkSession, sf: str) -> DataFrame:
    videos = read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    own = read(spark, sf, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("model_version"))
    return maintain.index_state(videos, own)


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source <> 'src5' UNION ALL SELECT doc_id + 1000000, 'zz', n_chars FROM documents WHERE source = 'src5' AND lang = 'en'")
def replace_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    new = rows.where("source = 'src5' and lang = 'en'").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("zz").alias("lang"), "source", "n_chars")
    return maintain.replace_by(rows, new, "source").select("doc_id", "lang", "n_chars")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return maintain.cascade_delete({"orders": read(spark, sf, "orders")}, gone, "o_custkey")["orders"].select("o_orderkey", "o_custkey")


@query("SELECT source, count(DISTINCT sha256(text)) AS n_distinct, count(*) AS n FROM documents GROUP BY source")
def distinct_content(spark: SparkSession, sf: str) -> DataFrame:
    return maintain.distinct_contents(read(spark, sf, "documents"), "text", ["source"])


# --- functions -------------------------------------------------------------------


@query(r"""
SELECT event_id, '[' || (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') || ']' AS bracket,
 CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS clock,
 s * 1000 AS parsed FROM (SELECT event_id, event_id * 7 AS s FROM events)""")
def time_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("event_id", (F.col("event_id") * 7000).alias("ms"))
    clock = T.clock_label(F.col("ms"))
    return rows.select("event_id", T.bracket_label(F.col("ms")).alias("bracket"), clock.alias("clock"), T.label_to_ms(clock).alias("parsed"))


@query(r"""
SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3.5)) END::BIGINT AS tokens,
 list_aggregate(list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda w: '"' || w || '"'), 'string_agg', ' OR ') AS match_query,
 len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: length(w) >= 2))::INT AS n_tokens FROM documents""")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents")
    return rows.select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"), F.nullif(T.match_query(F.col("text")), F.lit("")).alias("match_query"), F.size(T.search_tokens(F.col("text"))).alias("n_tokens"))


@query(r"""
SELECT doc_id, CASE lang WHEN 'en' THEN 'yt:' WHEN 'fr' THEN 'ig:' WHEN 'de' THEN 'tt:' ELSE lang || ':' END || doc_id::VARCHAR AS qualified,
 list_sort(list_distinct([lower(source), lang, 'tag'])) AS tags FROM documents""")
def ids_and_tags(spark: SparkSession, sf: str) -> DataFrame:
    platform = F.when(F.col("lang") == "en", "youtube").when(F.col("lang") == "fr", "instagram").when(F.col("lang") == "de", "tiktok").otherwise(F.col("lang"))
    tags = T.tag_union(T.tag_list(F.concat(F.lit("["), F.col("source"), F.lit(', "'), F.col("lang"), F.lit('"]'))), F.array(F.lit("Tag"), F.col("source")))
    return read(spark, sf, "documents").select("doc_id", T.qualified_id(platform, F.col("doc_id").cast("string")).alias("qualified"), tags.alias("tags"))


@query(r"""
SELECT page_id, starts_with(lower(url), 'https:') AS secure, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS raw_title,
 replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' ') AS title,
 try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS INT) AS height FROM pages""")
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return read(spark, sf, "pages").select("page_id", T.is_https(F.col("url")).alias("secure"), F.nullif(raw, F.lit("")).alias("raw_title"), T.html_unescaped(raw).alias("title"), T.first_height(F.col("url")).alias("height"))


_LINKS = "CASE page_id % 6 WHEN 0 THEN 'https://youtu.be/abcdefghi' || lpad((page_id % 100)::VARCHAR, 2, '0') WHEN 1 THEN 'https://www.youtube.com/watch?t=1&v=ABCDEFGHI' || lpad((page_id % 100)::VARCHAR, 2, '0') WHEN 2 THEN 'https://www.tiktok.com/@a/video/70000' || page_id::VARCHAR WHEN 3 THEN 'https://www.instagram.com/reel/C' || page_id::VARCHAR || '/' WHEN 4 THEN 'https://www.youtube.com/' ELSE url END"


@query(rf"""
WITH l AS (SELECT page_id, {_LINKS} AS link FROM pages)
SELECT page_id, CASE WHEN link ILIKE '%youtube.com%' OR link ILIKE '%youtu.be%' THEN 'youtube' WHEN link ILIKE '%tiktok.com%' THEN 'tiktok' WHEN link ILIKE '%instagram.com%' THEN 'instagram' END AS platform,
 coalesce(nullif(regexp_extract(link, '(youtu\.be/|[?&]v=)([A-Za-z0-9_-]{{11}})$', 2), ''), nullif(regexp_extract(link, '/video/([0-9]{{6,25}})', 1), ''), nullif(regexp_extract(link, '/reel/([A-Za-z0-9_-]+)', 1), '')) AS raw_id FROM l""")
def url_route(spark: SparkSession, sf: str) -> DataFrame:
    n, two = F.col("page_id").cast("string"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0")
    kind = F.col("page_id") % 6
    link = (
        F.when(kind == 0, F.concat(F.lit("https://youtu.be/abcdefghi"), two))
        .when(kind == 1, F.concat(F.lit("https://www.youtube.com/watch?t=1&v=ABCDEFGHI"), two))
        .when(kind == 2, F.concat(F.lit("https://www.tiktok.com/@a/video/70000"), n))
        .when(kind == 3, F.concat(F.lit("https://www.instagram.com/reel/C"), n, F.lit("/")))
        .when(kind == 4, F.lit("https://www.youtube.com/"))
        .otherwise(F.col("url"))
    )
    rows = read(spark, sf, "pages").select("page_id", link.alias("link"))
    link = F.col("link")
    return rows.select("page_id", T.platform_of(link).alias("platform"), F.coalesce(T.youtube_id(link), T.tiktok_id(link), T.instagram_code(link)).alias("raw_id"))


@query("""
WITH f AS (SELECT p_brand, p_partkey AS format_id, (p_size % 8 + 1) * 180 AS height, CASE WHEN p_partkey % 4 = 0 THEN 60 ELSE 30 END AS fps, CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS codec, p_retailprice AS d FROM part),
c AS (SELECT *, max(d) OVER (PARTITION BY p_brand) AS m FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN height = 1080 THEN 0 WHEN height < 1080 THEN 1 ELSE 2 END, CASE WHEN height < 1080 THEN -height ELSE height END, fps > 30, codec, format_id) AS n FROM c WHERE codec IS NOT NULL AND d >= 0.9 * m)
SELECT p_brand, format_id, height, fps FROM o WHERE n = 1""")
def stream_select(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    mime = F.when(k == 0, "video/webm; codecs=vp9").when(k.isin(1, 3), "video/mp4; codecs=avc1").when(k == 2, "video/mp4; codecs=av01").otherwise("audio/mp4")
    rows = read(spark, sf, "part").select("p_brand", F.col("p_partkey").alias("format_id"), ((F.col("p_size") % 8 + 1) * 180).alias("height"), F.when(F.col("p_partkey") % 4 == 0, 60).otherwise(30).alias("fps"), mime.alias("mime"), F.lit("u").alias("url"), F.col("p_retailprice").alias("duration_ms"))
    return select.best_stream(rows, "p_brand", 1080).select("p_brand", "format_id", "height", "fps")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


# --- frames of a stream, sizes, state ------------------------------------------------


@query("""
WITH t AS (SELECT event_id AS target_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
g AS (SELECT max(event_id) AS segment, user_id, epoch_us(ts) AS p FROM events WHERE event_type = 'view' GROUP BY ALL),
w AS (SELECT t.*, g.segment, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN p <= t THEN 0 ELSE 1 END, abs(p - t)) AS n FROM t JOIN g USING (user_id)),
s AS (SELECT segment, i AS sample, p + (i * 2 % 3) * 3600000000 AS pts FROM g, range(3) r(i))
SELECT target_id, w.segment, coalesce(min(sample) FILTER (pts >= t), max(sample)) AS sample FROM w JOIN s USING (segment) WHERE n = 1 GROUP BY target_id, w.segment""")
def frame_locate(spark: SparkSession, sf: str) -> DataFrame:
    """Views stand for segments, each with three samples whose times are out of order; errors are the targets."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("video_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"))
    segments = e.where("event_type = 'view'").groupBy("video_id", "pts").agg(F.max("event_id").alias("segment"))
    samples = segments.select("video_id", "segment", "pts", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("sample"))
    samples = samples.select("video_id", "segment", "sample", (F.col("pts") + F.col("sample") * 2 % 3 * 3_600_000_000).alias("pts"))
    targets = e.where("event_type = 'error'").select("video_id", F.col("event_id").alias("target_id"), "pts")
    return asof.locate_frames(targets, segments, samples).select("target_id", "segment", "sample")


@query("""
WITH p AS (SELECT p_partkey, p_size * 97 AS w, p_partkey % 41 * 90 AS h, [720, 1080, 1440, 2160, 480][p_partkey % 5 + 1] AS target FROM part),
e AS (SELECT *, CASE target WHEN 720 THEN 1280 WHEN 1440 THEN 2560 WHEN 2160 THEN 3840 ELSE 1920 END AS cap FROM p),
f AS (SELECT *, CASE WHEN greatest(w, h) <= 0 THEN cap ELSE least(greatest(w, h), cap) END AS edge FROM e),
g AS (SELECT *, CASE WHEN greatest(w, h) > 1000 THEN 1000::DOUBLE / greatest(w, h) ELSE 1.0 END AS s FROM f)
SELECT p_partkey, edge::INT AS edge, round(w * s)::INT AS width, round(h * s)::INT AS height FROM g""")
def output_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select("p_partkey", (F.col("p_size") * 97).alias("w"), (F.col("p_partkey") % 41 * 90).alias("h"), F.element_at(F.array(*(F.lit(t) for t in (720, 1080, 1440, 2160, 480))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("target"))
    size = select.output_size(F.col("w"), F.col("h"), 1000)
    return rows.select("p_partkey", select.long_edge(F.col("w"), F.col("h"), F.col("target")).cast("int").alias("edge"), size["width"].alias("width"), size["height"].alias("height"))


@query("""
WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'begun' WHEN 'error' THEN 'failed' ELSE 'indexed' END AS state FROM events),
b AS (SELECT user_id, max(event_id) AS f FROM l WHERE state = 'begun' GROUP BY ALL),
e AS (SELECT l.user_id, arg_max(state, event_id) AS state, max(event_id) AS last FROM l JOIN b USING (user_id) WHERE l.state <> 'begun' AND event_id > f GROUP BY ALL)
SELECT b.user_id, coalesce(e.state, 'indexing') AS state, e.last AS finished FROM b LEFT JOIN e USING (user_id)""")
def index_status(spark: SparkSession, sf: str) -> DataFrame:
    """Views begin, errors fail, all other events finish."""
    state = F.when(F.col("event_type") == "view", "begun").when(F.col("event_type") == "error", "failed").otherwise("indexed")
    log = read(spark, sf, "events").select(F.col("user_id").alias("folder"), F.col("event_id").alias("seq"), state.alias("state"), F.col("event_type").alias("reason"), F.col("event_id").alias("at"))
    return maintain.statuses(log).select(F.col("folder").alias("user_id"), "state", F.col("finished_at").alias("finished"))


@query("""
WITH v AS (SELECT doc_id, 'f' || (doc_id + CASE WHEN doc_id % 3 = 0 THEN 1000000 ELSE 0 END) AS folder FROM documents),
d AS (SELECT doc_id, min('f' || doc_id) AS folder FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 > 0 GROUP BY ALL)
SELECT v.doc_id, CASE WHEN v.folder NOT IN (SELECT folder FROM d) AND d.folder IS NOT NULL THEN d.folder ELSE v.folder END AS folder, v.folder NOT IN (SELECT folder FROM d) AND d.folder IS NOT NULL AS healed
FROM v LEFT JOIN d USING (doc_id)""")
def healed_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Every third document is stored with a folder that is not there; odd ones of them are found nowhere."""
    docs = read(spark, sf, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit("f"), c.cast("string"))
    stored = docs.select(F.col("doc_id").alias("video_id"), name(F.col("doc_id") + F.when(F.col("doc_id") % 3 == 0, 1_000_000).otherwise(0)).alias("folder"))
    there = docs.where("doc_id % 2 = 0 OR doc_id % 3 > 0").select(F.col("doc_id").alias("video_id"), name(F.col("doc_id")).alias("folder"))
    return maintain.heal_folders(stored, there).select(F.col("video_id").alias("doc_id"), "folder", "healed")


# --- chunking ----------------------------------------------------------------------


@query()
def chunk_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts, a turn every ten seconds; a fold in time, which SQL does not express."""
    rows = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.lit("body").alias("kind"), F.col("turn").alias("seq"), (F.col("turn") * 10_000).alias("start_ms"), "text")
    rows = windows.segment_ends(rows, ["video_id", "kind"], "seq")
    videos = rows.select("video_id").distinct().select("video_id", F.lit("t").alias("title"), F.lit("c").alias("channel"), F.lit("youtube").alias("platform"), F.array(F.lit("x")).alias("tags"))
    return chunking.chunk_segments(rows, videos).select("video_id", "chunk_index", "chunk_start_ms", "chunk_end_ms", F.length("chunk_text").alias("n_chars"))


from . import source_queries  # noqa: E402, F401  registers its queries with the same decorator
