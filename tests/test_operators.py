import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import asof, chunking, maintain, retrieval, select, text_index, windows
from quarry.sources import sinks

MODEL, DIM = "hash/48", 48
VOCABULARY = "amber basalt cedar delta ember fjord grove harbor inlet juniper kelp lagoon meadow nectar orchard prairie".split()
PLATFORMS = ("youtube", "instagram", "tiktok")


def unit(rng):
    v = rng.normal(size=DIM)
    return (v / np.linalg.norm(v)).astype("float32").tolist()


def library(seed=41, videos=7):
    """Rows of a made-up collection: (videos, chunks, frames)."""
    rng = np.random.default_rng(seed)
    people, parts, frames = [], [], []
    for i in range(videos):
        name, platform = f"v{i:02d}", PLATFORMS[i % 3]
        length = int(rng.integers(12, 200)) * 1000
        people.append((name, platform, " ".join(rng.choice(VOCABULARY, 3)), length, 1000 + i))
        kinds = ["header", "description"] + ["body"] * int(rng.integers(1, 6))
        cuts = sorted(rng.integers(0, length, 2 * kinds.count("body")).tolist())
        for k, kind in enumerate(kinds):
            at = cuts[2 * (k - 2) : 2 * (k - 2) + 2] if kind == "body" else (None, None)
            parts.append((100 * i + k, name, platform, kind, *at, " ".join(rng.choice(VOCABULARY, int(rng.integers(3, 15)))), MODEL if rng.random() < 0.9 else "old/48", unit(rng)))
        if i != 4:  # one video without frames
            frames += [(10_000 + 50 * i + k, name, platform, int(t), unit(rng)) for k, t in enumerate(sorted(set(rng.integers(0, length, 6).tolist())))]
    return people, parts, frames


PEOPLE, PARTS, FRAMES = library()
DURATION = {v[0]: v[3] for v in PEOPLE}


def cosine_distance(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def capped(ordered, group, most):
    seen, out = {}, []
    for x in ordered:
        seen[group(x)] = seen.get(group(x), 0) + 1
        if seen[group(x)] <= most:
            out.append(x)
    return out


@pytest.fixture(scope="module")
def stored(spark):
    videos = spark.createDataFrame(PEOPLE, "video_id string, platform string, title string, duration_ms bigint, date_saved bigint")
    chunks = spark.createDataFrame(PARTS, "chunk_id bigint, video_id string, platform string, chunk_type string, chunk_start_ms bigint, chunk_end_ms bigint, chunk_text string, model_version string, embedding array<float>")
    frames = spark.createDataFrame(FRAMES, "frame_id bigint, video_id string, platform string, frame_ms bigint, embedding array<float>")
    return videos, chunks.cache(), frames.cache()


@pytest.mark.parametrize("platform,k", [(None, 5), ("tiktok", 50), (None, 1)])
def test_dense_top_k(stored, platform, k):
    _, chunks, _ = stored
    query = unit(np.random.default_rng(5))
    want = sorted((cosine_distance(p[8], query), p[0]) for p in PARTS if platform in (None, p[2]))[:k]
    got = retrieval.dense_top_k(chunks, query, k, platform=platform).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [i for _, i in want] and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    assert [r["distance"] for r in got] == pytest.approx([d for d, _ in want], abs=1e-6)


def test_dense_top_k_of_a_model(stored):
    _, chunks, _ = stored
    query = PARTS[3][8]
    near = sorted((cosine_distance(p[8], query), p[0], p[7]) for p in PARTS)[:6]
    cut = lambda **kw: [r["chunk_id"] for r in retrieval.dense_top_k(chunks, query, 6, model_version=MODEL, **kw).orderBy("rank").collect()]
    assert cut() == [i for _, i, m in near if m == MODEL]
    assert cut(prefilter=True) == [i for _, i in sorted((cosine_distance(p[8], query), p[0]) for p in PARTS if p[7] == MODEL)[:6]]
    assert retrieval.dense_top_k(chunks, query, 9, model_version="none").count() == 0 and retrieval.dense_top_k(chunks, query[:-1], 9).count() == 0


def bm25(rows, query):
    """[(score, id)] in order, by a loop over (id, text)."""
    words = query.lower().replace("?", " ").replace("_", " ").split()
    bags = {i: t.lower().split() for i, t in rows}
    mean = sum(map(len, bags.values())) / len(bags)
    scores = {}
    for w in words:
        df = sum(w in b for b in bags.values())
        idf = math.log((len(bags) - df + 0.5) / (df + 0.5))
        for i, b in bags.items():
            if w in b:
                tf = b.count(w)
                scores[i] = scores.get(i, 0) - (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
    return sorted((s, i) for i, s in scores.items())


@pytest.mark.parametrize("query", ["Fjord?", "kelp_kelp lagoon", "cedar nowhere ember"])
def test_sparse_top_k(spark, stored, tmp_path, query):
    _, chunks, _ = stored
    want = bm25([(p[0], p[6]) for p in PARTS], query)
    got = retrieval.sparse_top_k(chunks, query, 50).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [i for _, i in want] and [r["score"] for r in got] == pytest.approx([s for s, _ in want])
    some = {p[0] for p in PARTS if p[2] == "instagram"}
    assert [r["chunk_id"] for r in retrieval.sparse_top_k(chunks, query, 50, where=F.col("platform") == "instagram").orderBy("rank").collect()] == [i for _, i in want if i in some]
    text_index.build_index(chunks, f"{tmp_path}/index")
    stored_hits = text_index.search_index(spark, f"{tmp_path}/index", query).orderBy("rank").collect()
    assert [r["chunk_id"] for r in stored_hits] == [i for _, i in want] and [r["score"] for r in stored_hits] == pytest.approx([s for s, _ in want])


def test_queries_without_words(spark, stored, tmp_path):
    _, chunks, _ = stored
    text_index.build_index(chunks, f"{tmp_path}/index")
    assert retrieval.sparse_top_k(chunks, "-- _ !", 50).count() == 0 and text_index.search_index(spark, f"{tmp_path}/index", "-- _ !").count() == 0


def test_one_rule_cuts_query_and_text(spark):
    composed, parted = "caf\u00e9", "cafe\u0301"
    df = spark.createDataFrame([(1, f"x {composed}"), (2, f"{parted} y_z"), (3, "none")], "chunk_id bigint, chunk_text string")
    hits = lambda q: {r["chunk_id"] for r in retrieval.sparse_top_k(df, q, 9).collect()}
    assert hits(composed) == {1} and hits(parted) == {2} and hits("z") == {2} and hits("y_z") == {2}


def test_sync_index(spark, tmp_path):
    path = f"{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "chunk_id bigint, chunk_text string")
    assert [text_index.sync_index(rows, path) for _ in range(2)] == [0, 0]
    more = rows.unionByName(spark.createDataFrame([(3, "c c")], rows.schema))
    assert text_index.sync_index(more, path) == 1 and text_index.newest(spark, path) == 1
    assert {r["chunk_id"] for r in text_index.search_index(spark, path, "c").collect()} == {2, 3}
    assert {r["chunk_id"] for r in text_index.search_index(spark, path, "c", version=0).collect()} == {2}
    changed = more.withColumn("chunk_text", F.when(F.col("chunk_id") == 3, "a").otherwise(F.col("chunk_text")))
    assert text_index.sync_index(changed, path) == 2 and {r["chunk_id"] for r in text_index.search_index(spark, path, "a").collect()} == {1, 3}


def ranks(spark, ids):
    return spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "chunk_id bigint, rank int")


def fuse(dense, sparse):
    """[(id, score)] of two lists by reciprocal ranks; ties go to the list and place an id came from first."""
    score, first = {}, {}
    for place, ids in enumerate((dense, sparse)):
        for r, i in enumerate(ids, 1):
            score[i] = score.get(i, 0) + 1 / (60 + r)
            first.setdefault(i, (place, r))
    return sorted(score.items(), key=lambda x: (-x[1], first[x[0]], x[0]))


def test_fusion_and_caps(spark, stored):
    _, chunks, _ = stored
    rng = np.random.default_rng(17)
    ids = [p[0] for p in PARTS] + [77_777]  # one id is of no chunk
    dense, sparse = rng.permutation(ids)[:20].tolist(), rng.permutation(ids)[:20].tolist()
    want = fuse(dense, sparse)
    lists = [("dense", ranks(spark, dense)), ("sparse", ranks(spark, sparse))]
    got = retrieval.rrf(lists).orderBy(*retrieval.fused_order("chunk_id")).collect()
    assert [r["chunk_id"] for r in got] == [i for i, _ in want] and [r["score"] for r in got] == pytest.approx([s for _, s in want])
    assert all(r["dense_rank"] == (dense.index(r["chunk_id"]) + 1 if r["chunk_id"] in dense else None) for r in got)
    video = {p[0]: p[1] for p in PARTS}
    best = capped([i for i, _ in want if i in video], video.get, 2)[:15]
    assert [r["chunk_id"] for r in retrieval.hybrid_search(chunks, lists).orderBy("place").collect()] == best


def test_find_similar(stored):
    _, chunks, _ = stored
    for anchor in ("v00", "v05"):
        own = [np.asarray(p[8], dtype=float) for p in PARTS if p[1] == anchor and p[3] == "body" and p[7] == MODEL]
        heads = sorted((cosine_distance(p[8], np.mean(own, axis=0)), p[0], p[1], p[7]) for p in PARTS if p[3] == "header")
        want = [v for _, _, v, m in heads if v != anchor and m == MODEL]
        assert [r["video_id"] for r in retrieval.find_similar(chunks, anchor, 10, model_version=MODEL, dim=DIM).collect()] == want
    assert retrieval.find_similar(chunks, "none", 10, model_version=MODEL, dim=DIM).count() == 0


def test_search_frames(stored):
    videos, _, frames = stored
    query = unit(np.random.default_rng(23))
    near = capped(sorted((cosine_distance(f[4], query), f[0], f[1], f[3]) for f in FRAMES), lambda f: f[2], 3)[:10]
    got = retrieval.search_frames(frames, videos, query).orderBy(F.col("score").desc()).collect()
    assert [r["frame_id"] for r in got] == [f[1] for f in near]
    assert [r["frame_label"] for r in got] == [f"[{f[3] // 60_000}:{f[3] // 1000 % 60:02d}]" for f in near]


def test_frames_for_chunks(stored):
    videos, chunks, frames = stored
    got = {r["chunk_id"]: r["frame_ids"] for r in asof.frames_for_chunks(chunks.join(videos.select("video_id", "duration_ms"), "video_id"), frames).collect()}
    for cid, video, _, kind, start, end, *_ in PARTS:
        own = [(f[3], f[0]) for f in FRAMES if f[1] == video]
        want = []
        if kind == "body" and own:
            middle = (start + end) // 2 if end > start else start
            nearest = lambda t: min(own, key=lambda f: (abs(f[0] - t), -f[0]))[1]
            want = [nearest(middle)]
            if DURATION[video] >= 30_000 and nearest(middle + 10_000) != want[0]:
                want.append(nearest(middle + 10_000))
        assert got[cid] == want


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 120), rng.integers(0, 60, 120)))]
    right = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 60, 40)))]
    L, R = spark.createDataFrame(left, "lid int, k int, t bigint"), spark.createDataFrame(right, "rid int, k int, rt bigint")
    args = {"key": "k", "left_time": "t", "right_time": "rt", "right_id": "rid"}

    def brute(order):
        return {i: min(((order(t, rt), r) for r, rk, rt in right if rk == k), default=(0, None))[1] for i, k, t in left}

    cases = [
        (asof.nearest(L, R, **args), lambda t, r: (abs(t - r), -r)),
        (asof.nearest(L, R, tie="earlier", **args), lambda t, r: (abs(t - r), r)),
        (asof.backward(L, R, **args), lambda t, r: (r > t, abs(t - r))),
        (asof.forward(L, R, **args), lambda t, r: (r < t, abs(t - r))),
    ]
    for df, order in cases:
        assert {r["lid"]: r["match_id"] for r in df.collect()} == brute(order)


def test_even_sample(spark):
    rows = spark.range(11).withColumn("k", F.lit(1))
    picks = lambda cap: sorted(r["id"] for r in asof.even_sample(rows, ["k"], [F.col("id")], cap).collect())
    assert picks(6) == [0, 2, 4, 6, 8, 10] and picks(1) == [0] and picks(20) == list(range(11))


def test_frame_times(spark):
    df = spark.createDataFrame([(10.0,), (0.0,)], "d double").select(windows.frame_times(F.col("d"), 100, 2.0).alias("t")).collect()
    assert df[0]["t"] == [i * 0.5 for i in range(20)] and df[1]["t"] == []


def test_drop_held_and_near(spark):
    rows = spark.createDataFrame([("v", 1, "A b"), ("v", 2, " a  B"), ("v", 3, ""), ("v", 4, "a b"), ("v", 5, "c"), ("v", 6, "A b")], "video_id string, ms int, text string")
    assert sorted(r["ms"] for r in windows.drop_held(rows, ["video_id"], ["ms"], "text").collect()) == [1, 5, 6]
    near = spark.createDataFrame([("v", 1, [0.0]), ("v", 2, [0.2]), ("v", 3, [0.29]), ("v", 4, [0.31]), ("v", 5, None), ("v", 6, [0.32])], "video_id string, ms int, v array<double>")
    assert sorted(r["ms"] for r in windows.drop_near(near, "video_id", "ms", "v", 0.3).collect()) == [1, 4, 5, 6]


SEGMENT = "x" * 70


@pytest.mark.parametrize("n,chunks,compat", [(19, [(0, 180000)], 1), (20, [(0, 190000)], 1), (21, [(0, 200000), (170000, 200000)], 1), (22, [(0, 200000), (170000, 210000)], 2), (37, [(0, 200000), (170000, 360000)], 2), (38, [(0, 200000), (170000, 370000), (340000, 370000)], 2), (40, [(0, 200000), (170000, 370000), (340000, 390000)], 3)])
def test_buckets(n, chunks, compat):
    segments = [(i * 10000, (i + 1) * 10000 if i + 1 < n else None, SEGMENT) for i in range(n)]
    assert [(s, e) for s, e, _ in chunking.timed_chunks(segments)] == chunks
    assert len(chunking.timed_chunks(segments, compat=True)) == compat


def test_split_text():
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(120))
    parts = chunking.split_text(text)
    assert all(chunking.tokens(p) <= 480 for p in parts) and parts[0].startswith("Sentence number 0") and parts[-1].endswith("119 has a few words in it.")
    assert chunking.split_text("  ") == [] and chunking.split_text("short") == ["short"]
    long = chunking.split_text("word " * 3000)
    assert len(long) > 5 and sum(len(p.split()) for p in long) == 3000
    assert [p[:2] for p in chunking.cut_long(0, 1000, "word " * 900)][0] == (0, 1000 // len(chunking.split_text("word " * 900, 400, 0)))


def test_markdown():
    assert chunking.markdown("My Video", ["hello", "world"]) == "# My Video\n\nhello world\n"
    assert max(map(len, chunking.wrap("lorem ipsum dolor " * 50))) <= 80


def test_maintenance(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "id int, g string, model_version string")
    new = spark.createDataFrame([(9, "b", "z")], base.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(maintain.replace_by(base, new, "g")) == [(1, "a", "x"), (9, "b", "z")]
    assert rows(maintain.upsert(base, spark.createDataFrame([(2, "c", "w")], base.schema), ["id"])) == [(1, "a", "x"), (2, "c", "w"), (3, "b", "y")]
    kept, gone = maintain.purge_other_models(base, "x")
    assert kept.count() == 2 and gone.first()[0] == 1
    a, b = maintain.change_probe(base, "id", "g"), maintain.change_probe(base.where("id < 3"), "id", "g")
    assert maintain.changed(a, b) and not maintain.changed(a, a)
    assert rows(maintain.stale(spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k int, m int"), spark.createDataFrame([(1, 5), (2, 4)], "k int, done int"), key="k", changed="m", done="done")) == [(2, 5), (3, 5)]
    assert tuple(maintain.summary(spark.createDataFrame([("a", "indexed", 3), ("b", "failed", 0), ("c", "kept", 2)], "video_id string, action string, chunks int")).first()) == (1, 3, 0, 1, 0, 1)


def test_streams_and_tracks(spark):
    rows = [("v", 1, "video/mp4; codecs=avc1", "u", 720, 30, 100), ("v", 2, "video/mp4; codecs=avc1", "u", 1080, 60, 100), ("v", 3, "video/webm; codecs=vp9", "u", 1080, 30, 100), ("v", 4, "video/mp4; codecs=avc1", "u", 2160, 30, 50), ("v", 5, "audio/mp4", "u", None, None, 100)]
    df = spark.createDataFrame(rows, "video_id string, format_id int, mime string, url string, height int, fps int, duration_ms bigint")
    assert select.best_stream(df, "video_id", 1080).first()["format_id"] == 3
    assert select.best_stream(df, "video_id", 900).first()["format_id"] == 1
    assert select.best_stream(df, "video_id", 100).first()["format_id"] == 1
    pick = lambda items, f, kind: spark.createDataFrame([(items,)], f"x {kind}").select(f(F.col("x"))).first()[0]
    kind = "array<struct<lang:string,url:string>>"
    assert pick([("de", "a"), ("en-GB", "b")], select.pick_caption, kind)["url"] == "b"
    assert pick([("de", "a")], select.pick_caption, kind)["url"] == "a"
    assert pick(["de-DE", "fr-FR", "en-US"], lambda c: select.pick_locale(F.lit("fr_CA"), c), "array<string>") == "fr-FR"
    assert pick(["de-DE", "en-US"], lambda c: select.pick_locale(F.lit("xx"), c), "array<string>") == "en-US"


def test_identifiers(spark):
    df = spark.createDataFrame([(0, "yt:abc", "abc", "https://y/abc"), (1, "yt:abcd", "abcd", "https://y/abcd")], "position int, video_id string, raw_id string, url string")
    find = lambda x: [r["raw_id"] for r in select.resolve_identifier(df, x).collect()]
    assert find("https://y/abcd") == ["abcd"] and find("yt:abc") == ["abc"] and find("see /abc?x") == ["abc"] and find("zzz") == []


def test_library(spark):
    from quarry.plans.api import HashingEmbedder, Library, embed_column, truncated

    e = HashingEmbedder(64)
    videos = spark.createDataFrame([("yt:a", "Bread", "Baker", "youtube", "u1", 60000, 10), ("tt:b", "Cars", "Racer", "tiktok", "u2", 20000, 20)], "video_id string, title string, channel string, platform string, url string, duration_ms bigint, date_saved bigint")
    rows = [(1, "yt:a", "youtube", "header", 0, None, None, "Title: Bread baking"), (2, "yt:a", "youtube", "body", 0, 0, 40000, "knead the dough and bake bread"), (3, "tt:b", "tiktok", "header", 0, None, None, "Title: Cars racing bread"), (4, "tt:b", "tiktok", "body", 0, 0, 9000, "fast cars on a track")]
    chunks = embed_column(spark.createDataFrame(rows, "chunk_id bigint, video_id string, platform string, chunk_type string, chunk_index int, chunk_start_ms bigint, chunk_end_ms bigint, chunk_text string"), "chunk_text", e)
    frames = embed_column(spark.createDataFrame([(1, "yt:a", "youtube", 10000, "p1"), (2, "yt:a", "youtube", 30000, "p2"), (3, "tt:b", "tiktok", 5000, "p3")], "frame_id bigint, video_id string, platform string, frame_ms bigint, frame_path string"), "frame_path", e)
    lib = Library(videos, chunks, frames, e)
    got = lib.search("bread").collect()
    assert got[0]["video_id"] == "yt:a" and {r["chunk_id"]: r["frame_ids"] for r in got}[2] == [2]  # on a tie the later frame, which is the nearest ten seconds on as well
    late = Library(videos, chunks.withColumn("chunk_end_ms", F.when(F.col("chunk_id") == 2, 26_000).otherwise(F.col("chunk_end_ms"))), frames, e)
    assert {r["chunk_id"]: r["frame_ids"] for r in late.search("bread").collect()}[2] == [1, 2]
    assert {r["video_id"] for r in lib.search("bread", platform="tiktok").collect()} == {"tt:b"}
    assert {r["video_id"] for r in lib.search("bread", since_iso="1970-01-01T00:00:00.015Z").collect()} == {"tt:b"}
    assert lib.search_frames("p3", 1).first()["frame_id"] == 3
    assert [r["video_id"] for r in lib.find_similar("yt:a").collect()] == ["tt:b"]
    assert [r["frame_id"] for r in lib.view_frames("yt:a", [29000, 31000]).collect()] == [2] and lib.view_frames("yt:a").count() == 2
    assert [r["video_id"] for r in lib.list_videos().collect()] == ["tt:b", "yt:a"] and lib.get_video("yt:a").first()["frames"] == [10000, 30000]
    assert lib.get_transcript("yt:a").first()["chunk_text"].startswith("knead") and lib.stats().count() == 3
    assert truncated(list(range(300)))[-2:] == [254, 299]


def test_pick_video_by_codec(spark):
    urls = lambda *u: list(u)
    rows = [
        (1, [("bytevc1_x", urls("https://a/1")), ("H264_y", urls("https://www.tiktok.com/x", "https://a/2")), ("h264_z", urls("https://a/3"))], None),
        (2, [("bytevc2", urls("https://a/4"))], "https://a/5"), (3, [("other", urls("ftp://a/6", "https://a/7")), ("hevc", None)], "http://a/8"), (4, None, None), (5, [(None, urls("https://a/9"))], "https://b"),
    ]
    df = spark.createDataFrame(rows, "id int, b array<struct<codec: string, urls: array<string>>>, d string")
    got = {r["id"]: r["u"] for r in df.select("id", select.pick_video(F.col("b"), F.col("d")).alias("u")).collect()}
    assert got == {1: "https://a/2", 2: "https://a/5", 3: None, 4: None, 5: "https://a/9"}


def test_locate_frames_and_jobs(spark):
    segments = spark.createDataFrame([("v", 0, 0), ("v", 1, 100), ("w", 0, 5)], "video_id string, segment int, pts bigint")
    samples = spark.createDataFrame([("v", 0, 0, 0), ("v", 0, 1, 60), ("v", 0, 2, 30), ("v", 1, 0, 100), ("v", 1, 1, 130)], "video_id string, segment int, sample int, pts bigint")
    targets = spark.createDataFrame([("v", 1, 20), ("v", 2, 70), ("v", 3, 130), ("v", 4, -5), ("w", 5, 1), ("x", 6, 1)], "video_id string, target_id int, pts bigint")
    located = asof.locate_frames(targets, segments, samples)
    assert sorted(map(tuple, located.collect())) == [("v", 1, 0, 1), ("v", 2, 0, 2), ("v", 3, 1, 1), ("v", 4, 0, 0), ("w", 5, 0, None)]
    jobs = {(r["video_id"], r["segment"]): ([tuple(t) for t in r["targets"]], r["last_sample"]) for r in asof.segment_jobs(located).collect()}
    assert jobs[("v", 0)] == ([(1, 1), (2, 2), (4, 0)], 2) and jobs[("w", 0)] == ([(5, None)], None)


def test_state_of_the_index(spark):
    log = [("a", 1, "begun", None, 1), ("a", 2, "failed", "x", 2), ("a", 3, "begun", None, 3), ("b", 1, "begun", None, 1), ("b", 2, "failed", "y", 2), ("c", 1, "indexed", None, 1)]
    log = spark.createDataFrame(log, "folder string, seq int, state string, reason string, at int")
    assert sorted(map(tuple, maintain.statuses(log).collect())) == [("a", "indexing", None, None), ("b", "failed", "y", 2)]
    videos = spark.createDataFrame([("1", "p/old", 7), ("2", "p/2", 8), ("3", "p/gone", 9)], "video_id string, folder string, n int")
    found = spark.createDataFrame([("1", "p/z"), ("1", "p/new"), ("2", "p/2")], "video_id string, folder string")
    assert sorted(map(tuple, maintain.heal_folders(videos, found).collect())) == [("1", "p/new", 7, True), ("2", "p/2", 8, False), ("3", "p/gone", 9, False)]
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    kept, again = maintain.rebuilt_width(vectors, 2)
    assert [r["id"] for r in kept.collect()] == [1] and sorted(r["id"] for r in again.collect()) == [2, 3] and again.columns == ["id"]
    tables, version = maintain.upgraded({"v": vectors}, 1, {1: lambda t: 1 / 0, 3: lambda t: {**t, "w": t["v"]}, 2: lambda t: {"v": t["v"].limit(0)}})
    assert version == 3 and tables["w"].count() == 0 and maintain.has_rows(vectors) and not maintain.has_rows(tables["v"])


def test_backfill_and_jobs_run_once(spark):
    head = "---\nvideo_id: x\n---\n## Transcript\n\nhi\n"
    section = head + "## On-screen text\n\n"
    notes = spark.createDataFrame([("1", "a", head), ("2", "b", section + "[0:01] hi"), ("3", "c", section + "[0:01] hi"), ("4", "d", section + "_No on-screen text detected._"), ("5", "e", head), ("6", "f", None)], "video_id string, folder string, raw string")
    chunks = spark.createDataFrame([("2", "frame_text", "old"), ("3", "body", "new")], "video_id string, chunk_type string, model_version string")
    frames = spark.createDataFrame([(f, 1) for f in "abcdf"] + [("a", 2)], "folder string, frame_ms int")
    assert sorted(r["video_id"] for r in maintain.to_backfill(notes, chunks, frames).collect()) == ["1", "3", "6"]
    meta = spark.createDataFrame([], "key string, value string")
    runs = []
    meta = maintain.once(meta, "ocr", 1, lambda: runs.append(1))
    meta = maintain.once(meta, "ocr", 1, lambda: runs.append(2))
    with pytest.raises(ZeroDivisionError):
        maintain.once(meta, "ocr", 2, lambda: 1 / 0)
    assert runs == [1] and [tuple(r) for r in meta.collect()] == [("ocr", "1")]
    videos = notes.select("video_id")
    assert maintain.migration_offer(chunks, videos, meta, "new") == (1, 1) and maintain.migration_offer(chunks.where("model_version = 'new'"), videos, meta, "new") is None
    assert maintain.migration_offer(chunks, videos, maintain.set_meta(meta, "migration_offered_for", "new"), "new") is None


def test_blobs_with_nulls(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, None), (3, bytearray(b"abc")), (4, bytearray(np.array([1.5, -2], "<f4").tobytes()))], "id int, b binary")
    rows = {r["id"]: (r["v"], r["back"]) for r in df.withColumn("v", V.from_blob("b")).withColumn("back", V.to_blob("v")).collect()}
    assert rows[1] == ([], b"") and rows[2] == rows[3] == (None, None) and rows[4][0] == [1.5, -2.0] and len(rows[4][1]) == 8
    assert df.limit(0).select(V.from_blob("b")).collect() == []


def test_manifest_lines(spark, tmp_path):
    import json

    cols = "folder string, videoID string, dateSaved string"
    rows = spark.createDataFrame([("a", "1", "2024-01-01"), ("b", "2", "2024-03-01"), ("../c", "3", "2024-04-01"), ("d", "", "2024-05-01"), ("e", "5", None)], cols)
    for name, df, want in (("some", rows, ["2", "1", "5"]), ("none", rows.limit(0), [])):
        sinks.write_manifest(df, f"{tmp_path}/{name}")
        files = list((tmp_path / name).glob("part-*"))
        assert len(files) == 1 and [e["videoID"] for e in json.loads(files[0].read_text())] == want
