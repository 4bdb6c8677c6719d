"""What is stored and goes on: snapshots, indexes, scans over tasks, queues, listings, ranges of media files, reindexing."""

import json
import os
import random
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import asof, retrieval, scan, text_index, vector_index
from quarry.operators.reindex import MODEL_KEY, Reindex
from quarry.sources import listing, media_ranges
from quarry.sources.snapshots import Conflict, Snapshots, Tables

WORDS = [f"w{i}" for i in range(60)]
CHUNKS = "chunk_id long, platform string, chunk_text string"


# --- snapshots -------------------------------------------------------------------


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    log = Snapshots(spark, f"{tmp_path}/t")
    assert log.latest() is None and log.manifest() == {}
    assert log.commit({"a": 1}, None) == 0 and log.commit({"a": 2}, 0) == 1
    with pytest.raises(Conflict):
        Snapshots(spark, f"{tmp_path}/t").commit({"a": 3}, 0)
    assert log.versions() == [0, 1] and log.manifest(0) == {"a": 1} and log.manifest() == {"a": 2}
    assert not [n for n in os.listdir(f"{tmp_path}/t/_log") if n.startswith("tmp-")]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def tables(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/tables")
    videos = spark.createDataFrame([(f"v{i}", i) for i in range(20)], "video_id string, n int")
    chunks = spark.createDataFrame([(f"v{i % 20}", i) for i in range(60)] + [("v1", 1000 + i) for i in range(50)], "video_id string, c int")
    vectors = spark.createDataFrame([], "video_id string, x double")
    t.create({"videos": (videos, "video_id"), "chunks": (chunks, "video_id"), "vectors": (vectors, "video_id")}, buckets=8)
    return t


def test_three_tables_change_in_one_snapshot(spark, tables):
    before = {n: rows_of(tables.read(n)) for n in ("videos", "chunks", "vectors")}
    assert tables.replace({"videos": spark.createDataFrame([("v1", 77)], "video_id string, n int"), "chunks": spark.createDataFrame([("v1", 5), ("new", 6)], "video_id string, c int"), "vectors": spark.createDataFrame([("v1", 0.5)], "video_id string, x double")}) == 1
    assert rows_of(tables.read("videos")) == sorted([r for r in before["videos"] if r[0] != "v1"] + [("v1", 77)])
    assert rows_of(tables.read("chunks")) == sorted([r for r in before["chunks"] if r[0] != "v1"] + [("v1", 5), ("new", 6)])
    assert tables.delete(spark.createDataFrame([("v1",), ("v2",)], "id string")) == 2
    assert {r[0] for n in before for r in rows_of(tables.read(n))}.isdisjoint({"v1", "v2"})
    assert {n: rows_of(tables.read(n, 0)) for n in before} == before  # a pinned reader sees no later snapshot
    gone = tables.log.vacuum(keep=1)
    assert gone and tables.log.versions() == [2] and rows_of(tables.read("vectors")) == []


def test_a_run_killed_between_files_leaves_the_snapshot_before(spark, tables, monkeypatch):
    before = {n: rows_of(tables.read(n)) for n in ("videos", "chunks")}
    real, calls = Snapshots.put, []

    def dies(self, *a, **b):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *a, **b)

    monkeypatch.setattr(Snapshots, "put", dies)
    change = {"videos": spark.createDataFrame([("v3", 1)], "video_id string, n int"), "chunks": spark.createDataFrame([("v3", 1)], "video_id string, c int")}
    with pytest.raises(RuntimeError, match="killed"):
        tables.replace(change)
    assert {n: rows_of(tables.read(n)) for n in before} == before and tables.log.latest() == 0
    monkeypatch.setattr(Snapshots, "put", real)
    with pytest.raises(ValueError, match="did not name"):
        tables.change({"videos": lambda rows: rows.unionByName(spark.createDataFrame([(f"x{i}", 1) for i in range(40)], "video_id string, n int"))}, {"videos": spark.createDataFrame([("v3",)], "id string")})
    assert tables.replace(change) == 1
    with pytest.raises(Conflict):
        tables.replace(change, base=0)


# --- the text index ----------------------------------------------------------------


def corpus(seed, ids):
    rng = random.Random(seed)
    return [(i, rng.choice(["youtube", "tiktok", None]), None if i % 97 == 0 else " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40))) + " common" * (i % 4 > 0)) for i in ids]


def agree(spark, index, rows, queries, k=20):
    df = spark.createDataFrame(rows, CHUNKS)
    for query, kind in queries:
        want = [(r[0], pytest.approx(r[1])) for r in retrieval.sparse_top_k(df, query, k, where=None if kind is None else F.col("platform") == kind).orderBy("rank").collect()]
        assert [(r[0], r[1]) for r in index.search(query, k, kind=kind).orderBy("rank").collect()] == want, query


def test_index_after_syncs_edits_deletes_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    path, queries = f"{tmp_path}/ix", [("w3 w40 common", None), ("common common w0", "tiktok"), ("w59", None), ("w7_w8, nowhere", None)]
    rows = {r[0]: r for r in corpus(1, range(300))}
    index = text_index.open_index(spark.createDataFrame(list(rows.values()), CHUNKS), path, kind="platform")
    agree(spark, index, list(rows.values()), queries)
    sizes = [len(index.manifest["segments"])]
    for step in range(3):
        for i in range(3):  # edits, deletes, new rows: about one in a hundred
            rows[40 + 10 * step + i] = (40 + 10 * step + i, "tiktok", f"common w{step} w40 edited")
            rows.pop(100 + 10 * step + i)
            rows[1000 + 10 * step + i] = (1000 + 10 * step + i, "youtube", "w40 w59 common new")
        df = spark.createDataFrame(list(rows.values()), CHUNKS)
        index = index.sync(df, kind="platform")
        sizes.append(len(index.manifest["segments"]))
        if step == 0:
            made = index.manifest["segments"][-1]
            assert made["n"] == 6 and index.manifest["segments"][0]["n_dead"] == 6  # what changed, no more
    assert index.sync(df, kind="platform").version == index.version  # nothing changed
    assert sizes[1] == 2 and sizes[-1] < 4  # segments were merged on the way
    agree(spark, index, list(rows.values()), queries)
    whole = index.compact()
    assert len(whole.manifest["segments"]) == 1 and whole.size() == index.size() and whole.size()[0] == len(rows)
    agree(spark, whole, list(rows.values()), queries)
    known = whole.update(spark.createDataFrame([(5000, "tiktok", "w59 w59")], CHUNKS), spark.createDataFrame([(1000,)], "chunk_id long"), kind="platform")
    rows[5000] = (5000, "tiktok", "w59 w59")
    rows.pop(1000)
    agree(spark, known, list(rows.values()), queries[:3])
    assert whole.compact() is whole  # one segment, none dead
    with pytest.raises(Conflict):
        whole.update(gone=spark.createDataFrame([(1,)], "chunk_id long"))


def test_few_blocks_of_a_frequent_word_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(i, "youtube", "the " * rng.randrange(1, 30) + " ".join(rng.choices(WORDS, k=20)) + (" rare" * rng.randrange(1, 5) if i % 25 == 0 else "")) for i in range(2_000)]
    index = text_index.open_index(spark.createDataFrame(rows, CHUNKS), f"{tmp_path}/ix", kind="platform")
    _, report = index.search_with_report("the rare the", 10)
    words = index.blocks_read(report).words
    assert words["the"]["blocks"] >= 125 and words["the"]["read"] <= 2 and 0 < words["rare"]["read"] <= words["rare"]["blocks"]
    agree(spark, index, rows, [("the rare the", None), ("the", None), ("the w5", "youtube"), ("w1 w2 w3", None)], 10)
    _, alone = index.search_with_report("the", 10)
    assert index.blocks_read(alone).words["the"]["read"] < words["the"]["blocks"] / 4


def test_freshness_is_told_by_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame(corpus(2, range(50)), CHUNKS).write.parquet(f"{tmp_path}/rows")
    read = lambda: spark.read.parquet(f"{tmp_path}/rows")
    index = text_index.open_index(read(), f"{tmp_path}/ix", kind="platform")
    monkeypatch.setattr(text_index.TextIndex, "_named", lambda *a: pytest.fail("texts were read"))
    assert index.sync(read(), kind="platform") is index and index.fresh(read())
    monkeypatch.undo()
    spark.createDataFrame([(9_999, "tiktok", "fresh w1")], CHUNKS).write.mode("append").parquet(f"{tmp_path}/rows")
    assert not index.fresh(read())
    later = index.sync(read(), kind="platform")
    assert [r[0] for r in later.search("fresh").collect()] == [9_999] and index.search("fresh").count() == 0  # the older handle is pinned


def test_index_of_nothing_and_of_awkward_rows(spark, tmp_path):
    none = text_index.open_index(spark.createDataFrame([], CHUNKS), f"{tmp_path}/none", kind="platform")
    assert none.search("x").count() == 0
    rows = [(None, "youtube", "w1"), (1, None, None), (2, "tiktok", ""), (3, "tiktok", "w1 " * 50_000), (4, "youtube", "w1 ÉTÉ")]
    index = none.sync(spark.createDataFrame(rows, CHUNKS), kind="platform")
    assert [r[0] for r in index.search("w1").orderBy("rank").collect()] == [r[0] for r in retrieval.sparse_top_k(spark.createDataFrame(rows[1:], CHUNKS), "w1").orderBy("rank").collect()]
    assert [r[0] for r in index.search("été").collect()] == [4] and index.search("w1", kind="none").count() == 0
    text = text_index.open_index(spark.createDataFrame([("a", "youtube", "w1 w2"), ("b", None, "w2")], "chunk_id string, platform string, chunk_text string"), f"{tmp_path}/text", kind="platform")
    assert [r[0] for r in text.search("w1").collect()] == ["a"]


# --- the vector index ----------------------------------------------------------------


def vectors(seed, n, dim=16, groups=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 4
    rows = [(i, int(i % groups), (centres[i % groups] + rng.normal(size=dim) * 0.3).astype("float32").tolist()) for i in range(n)]
    rows += [(n, 1, rows[3][2]), (n + 1, 2, [0.0] * dim), (n + 2, 3, None), (n + 3, 4, [1.0] * (dim - 1)), (n + 4, 5, [0.0] * dim)]  # a tie, no direction, no vector, another width
    return rows


VECTORS = "id long, label int, embedding array<float>"


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_index_is_exact_and_reads_few_cells(spark, tmp_path, metric):
    rows = vectors(3, 1_500)
    df = spark.createDataFrame(rows, VECTORS)
    index = vector_index.open_vectors(df, f"{tmp_path}/v", id="id", vector="embedding", dim=16, metric=metric, keep=("label",))
    for query, k, where in ((rows[3][2], 12, None), (rows[8][2], 5, F.col("label").isin(8, 9)), ([0.1] * 16, 30, None), ([0.0] * 16, 3, None), (rows[0][2], 5_000, None)):
        want = rows_of(retrieval.dense_top_k(df if where is None else df.where(where), query, k, id="id", metric=metric))
        got, report = index.search_with_report(query, k, where=where, id="id")
        assert rows_of(got) == want
        if k == 12:
            assert report["cells_read"] <= report["cells"] / 4 and report["rows_read"] < report["rows"] / 4


def test_nearest_join_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "BLOCK", 7)
    rows = vectors(5, 400, groups=6)
    df = spark.createDataFrame(rows, VECTORS)
    index = vector_index.open_vectors(df, f"{tmp_path}/v", id="id", vector="embedding", dim=16, keep=("label",))
    asked = df.where("id % 9 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    got = {}
    for r in index.nearest_join(asked, 4, keep=("label",)).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], r["label"]))
    unit = {i: (np.array(v, dtype=float), l) for i, l, v in rows if v is not None and len(v) == 16}
    cos = lambda a, b: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9))
    for q in [i for i in unit if i % 9 == 0 and np.linalg.norm(unit[i][0]) > 0]:
        near = sorted((-round(cos(unit[q][0], v), 12), i, l) for i, (v, l) in unit.items() if i != q)[:4]
        assert [(i, l) for _, i, l in sorted(got[q])] == [(i, l) for _, i, l in near]
    assert set(got) == {i for i in unit if i % 9 == 0 and np.linalg.norm(unit[i][0]) > 0}


# --- scans over tasks -------------------------------------------------------------------


@pytest.fixture()
def many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_key_over_all_tasks(spark, many_tasks):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(100)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, v long").withColumn("_tasks", F.lit(0))
    out = scan.scanned(df, "k", [F.col("t")], sums=("v",), last=("v",))
    want, sums, last = {}, {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        sums[k], last[k] = sums.get(k, 0) + (v or 0), v if v is not None else last.get(k)
        want[t] = (sums[k], last[k])
    assert {r["t"]: (r["upto_v"], r["last_v"]) for r in out.collect()} == want
    ranged = df.repartitionByRange("k", "t").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert ranged >= 4  # the key's rows are dealt over several tasks
    before = {r["t"]: r["b"] for r in scan.previous(df, "k", [F.col("t")], "v", "b").collect()}
    seen = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        assert before[t] == seen.get(k)
        seen[k] = v


@pytest.mark.parametrize("how", ["nearest", "backward", "forward"])
def test_as_of_over_tasks_equals_the_window(spark, many_tasks, how):
    rng = random.Random(7)
    left = spark.createDataFrame([(i, rng.choice(["hot"] * 5 + ["b", "none"]), rng.randrange(400)) for i in range(300)], "i int, k string, t long")
    right = spark.createDataFrame([(i, rng.choice(["hot"] * 5 + ["b", "c"]), rng.randrange(400)) for i in range(200)], "r int, k string, rt long")
    names = {"key": "k", "left_time": "t", "right_time": "rt", "right_id": "r"}
    join = getattr(asof, how)
    assert rows_of(join(left, right, **names, spread=True).fillna(-1)) == rows_of(join(left, right, **names).fillna(-1))


# --- the queue -----------------------------------------------------------------------------


def test_queue_starts_one_link_at_a_time_and_takes_it_again_when_done(spark, tmp_path):
    from quarry.streaming import queue

    spark.conf.set(*queue.STATE_STORE)
    kind, inbox = "queue string, kind string, url string, source string, at long, seq long", f"{tmp_path}/in"
    steps = [
        [("q", "save", "a", "share", 1, 0), ("q", "save", "a", "paste", 1, 1), ("q", "save", "b", "paste", 1, 2), ("q", "save", " b ", "menu", 1, 3), ("z", "save", "a", "menu", 1, 4), ("q", "save", "  ", "menu", 1, 5)],
        [("q", "save", "a", "share", 2, 0), ("q", "settled", "a", None, 3, 0), ("q", "save", "a", "again", 4, 0)],  # a runs: dropped; settled: b starts; a may come again
        [("q", "settled", "other", None, 5, 0), ("q", "settled", "b", None, 6, 0)],
        [("q", "settled", None, None, 7, 0), ("q", "save", "c", "x", 8, 0)],
    ]
    wanted = [[("q", 1, "a", "share"), ("z", 1, "a", "menu")], [("q", 2, "b", "paste")], [("q", 3, "a", "again")], [("q", 4, "c", "x")]]
    got = []
    for i, rows in enumerate(steps):  # each step is a run of its own, from the checkpoint of the one before
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(inbox)
        out = f"{tmp_path}/out{i}"
        run = queue.dispatched(spark.readStream.schema(kind).parquet(inbox)).writeStream.foreachBatch(lambda df, n, out=out: df.write.mode("append").parquet(out)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        run.awaitTermination()
        got.append(rows_of(spark.read.parquet(out)))
    assert got == wanted


# --- listings and ranges ---------------------------------------------------------------------


@pytest.fixture()
def vault(tmp_path):
    root = tmp_path / "vault"
    for platform, name, raw in (("youtube", "one", "Kq7Zk2wLm09"), ("tiktok", "two", "700001"), ("instagram", "three", "Cxy")):
        folder = root / platform / name
        folder.mkdir(parents=True)
        text = f"---\ntitle: Title {name}\nplatform: {platform}\nvideo_id: {raw}\nduration: 1:30\ndate_saved: 2024-05-06\ntags: [a, b]\n---\n\n## Transcript\n\n[0:00] hello from {name}\n[0:30] more words of it\n"
        (folder / "video.md").write_text(text)
        for ms in (0, 7560):
            (folder / f"{ms:08d}.jpg").write_bytes(b"x" * (ms + 1))
        (folder / "cover.jpg").write_bytes(b"c")
    (root / "youtube" / "one" / "00009000.JPG").write_bytes(b"up")
    (tmp_path / "secret").write_text("s")
    os.symlink(tmp_path / "secret", root / "youtube" / "one" / "00001234.jpg")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "00000001.jpg").write_bytes(b"o")
    os.symlink(tmp_path / "outside", root / "youtube" / "linked")
    return root


def test_listing_passes_over_links_and_takes_time_filters(spark, vault):
    files = listing.list_files(spark, str(vault))
    assert rows_of(listing.frame_files(files, least_digits=8).select("folder", "frame_ms")) == [("one", 0), ("one", 7560), ("one", 9000), ("three", 0), ("three", 7560), ("two", 0), ("two", 7560)]
    assert {r["folder"]: r["files"] for r in listing.bundle_files(files).collect()}["two"] == ["00000000.jpg", "00007560.jpg", "cover.jpg", "video.md"]
    assert {r["size"] for r in files.where("name = '00007560.jpg'").collect()} == {7561}
    os.utime(vault / "tiktok" / "two" / "video.md", (4_000_000_000, 4_000_000_000))
    late = listing.list_files(spark, f"file://{vault}", since_ms=3_900_000_000_000)
    assert [r["folder"] for r in listing.note_files(late).collect()] == ["two"]
    reader = listing.VaultFilesReader(str(vault), 2, 1)
    rest = list(reader.pushFilters([listing.GreaterThan(("mtime_ms",), 3_900_000_000_000), listing.GreaterThan(("size",), 1)]))
    assert len(rest) == 1 and [r[1] for p in reader.partitions() for r in reader.read(p)] == ["video.md"] and len(reader.partitions()) > 3
    assert listing.list_files(spark, f"{vault}/nowhere").count() == 0


def box(kind, body, wide=False):
    return (struct.pack(">I4sQ", 1, kind, 16 + len(body)) if wide else struct.pack(">I4s", 8 + len(body), kind)) + body


def moof(dts, sizes):
    trun = struct.pack(">IIi", 0x000301, len(sizes), 100) + b"".join(struct.pack(">II", 40, s) for s in sizes)
    return box(b"moof", box(b"mfhd", bytes(8)) + box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1)) + box(b"tfdt", struct.pack(">II", 0, dts)) + box(b"trun", trun)))


def test_a_file_of_five_gigabytes_costs_its_heads(spark, tmp_path):
    path, gap = tmp_path / "large.mp4", 1_700_000_000
    sidx = box(b"sidx", struct.pack(">IIIIIHH", 0, 1, 1000, 0, 0, 0, 2) + struct.pack(">IIIIII", 500, 2000, 0, 700, 3000, 0))
    with open(path, "wb") as f:
        f.write(box(b"ftyp", b"isom") + sidx)
        for i in range(3):
            f.write(moof(1000 * i, [10, 20 + i]))
            f.write(struct.pack(">I4sQ", 1, b"mdat", 16 + gap))
            f.seek(gap, os.SEEK_CUR)
        f.write(b"\0\0\0\x10cut")
    assert path.stat().st_size > 5_000_000_000
    tracemalloc.start()
    boxes = list(media_ranges.walked(str(path)))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    assert [b[1] for b in boxes] == ["ftyp", "sidx", "moof", "mdat", "moof", "mdat", "moof", "mdat"]
    files = spark.createDataFrame([(str(path),)], "path string")
    at = [b[2] for b in boxes if b[1] == "moof"]
    got = rows_of(media_ranges.samples(files).select("position", "size", "dts", "pts", "duration"))
    assert got == sorted((a + 100 + (10 if j else 0), s, 1000 * i + 40 * j, 1000 * i + 40 * j, 40) for i, a in enumerate(at) for j, s in enumerate((10, 20 + i)))
    end = boxes[1][2] + boxes[1][3]
    assert rows_of(media_ranges.segments(files).select("position", "size", "pts_ms", "duration_ms")) == [(end, 500, 0.0, 2000.0), (end + 500, 700, 2000.0, 3000.0)]


# --- reindexing ---------------------------------------------------------------------------------


def notes_of(spark, n, tail=""):
    text = "---\ntitle: T{i}\nplatform: youtube\nvideo_id: id{i}\nduration: 1:30\ndate_saved: 2024-05-06\ntags: [a]\n---\n\n## Transcript\n\n[0:00] first words of {i}{tail}\n[0:30] then others\n"
    rows = [(f"/v/youtube/f{i:02d}/video.md", f"f{i:02d}", 1000 + i, text.format(i=i, tail=tail)) for i in range(n)] + [("/v/youtube/bad/video.md", "bad", 5, "no frontmatter")]
    return spark.createDataFrame(rows, "path string, folder string, mtime_ms long, raw string")


def test_reindex_goes_on_where_it_was_killed(spark, tmp_path):
    done, path = [], f"{tmp_path}/ix"

    def embed_as(model, dies_at=None):
        def embed(chunks):
            done.append(model)
            if dies_at is not None and len(done) > dies_at:
                raise RuntimeError("killed")
            return chunks.withColumn("embedding", F.array(F.length("chunk_text").cast("float"))).withColumn("model_version", F.lit(model))

        return embed

    notes = notes_of(spark, 9)
    with pytest.raises(RuntimeError, match="killed"):
        Reindex(spark, path, embed_as("m1", 3), "m1", buckets=4).run(notes, batch=4)
    half = Reindex(spark, path, embed_as("m1"), "m1", buckets=4)
    assert half.tables.read("videos").count() == 7 and MODEL_KEY not in half.tables.meta()  # two batches: bad, f00 to f06
    done.clear()
    first = half.run(notes, batch=4)
    assert (first.videos, first.failures, first.off_model) == (2, 0, 0) and done == ["m1"]
    assert half.tables.meta() == {MODEL_KEY: "m1"} and half.state()["work"] == {("m1", "indexed"): 9, ("m1", "failed"): 1}
    assert half.run(notes).videos == 0  # nothing is pending

    done.clear()
    with pytest.raises(RuntimeError, match="killed"):  # a migration that is killed: the index stays mixed and keeps its model
        Reindex(spark, path, embed_as("m2", 1), "m2", buckets=4).run(notes, batch=5)
    other = Reindex(spark, path, embed_as("m2"), "m2", buckets=4)
    assert other.tables.meta() == {MODEL_KEY: "m1"} and {r[0] for r in other.tables.read("chunks").select("model_version").distinct().collect()} == {"m1", "m2"}
    assert other.run(notes, batch=5).off_model == 0 and other.tables.meta() == {MODEL_KEY: "m2"}

    changed = notes.where("folder <> 'f00'").withColumn("raw", F.when(F.col("folder") == "f01", F.concat("raw", F.lit("[0:50] news\n"))).otherwise(F.col("raw"))).withColumn("mtime_ms", F.when(F.col("folder") == "f01", 9_000).otherwise(F.col("mtime_ms")))
    last = other.run(changed)
    assert (last.videos, last.dropped) == (1, 1)
    assert other.tables.read("chunks").where("video_id = 'yt:id0'").count() == 0 and "news" in other.tables.read("chunks").where("video_id = 'yt:id1' AND chunk_type = 'body'").first()["chunk_text"]


def test_reindex_of_a_vault_opens_pending_notes_only(spark, tmp_path, vault, monkeypatch):
    from quarry.operators import reindex

    opened = []
    real = reindex.read_notes
    monkeypatch.setattr(reindex, "read_notes", lambda s, paths: opened.append(sorted(os.path.basename(os.path.dirname(p)) for p in paths)) or real(s, paths))
    embed = lambda chunks: chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float"))).withColumn("model_version", F.lit("m"))
    job = Reindex(spark, f"{tmp_path}/ix", embed, "m", buckets=2)
    assert job.run_vault(str(vault), batch=2).videos == 3 and opened == [["one", "three"], ["two"]]
    note = vault / "tiktok" / "two" / "video.md"
    note.write_text(note.read_text() + "[0:50] news\n")
    os.utime(note, (4_000_000_000, 4_000_000_000))
    opened.clear()
    assert job.run_vault(str(vault), batch=2).videos == 1 and opened == [["two"]]
    assert "news" in job.tables.read("chunks").where("video_id = 'tt:700001' AND chunk_type = 'body'").first()["chunk_text"]
    assert rows_of(job.tables.read("videos").select("video_id", "folder")) == [("ig:Cxy", "three"), ("tt:700001", "two"), ("yt:Kq7Zk2wLm09", "one")]


def test_library_answers_from_the_index(spark, tmp_path, vault):
    from quarry.plans.api import HashingEmbedder, Library, embed_column
    from quarry.sources.vault import parse_notes, scan_notes

    e = HashingEmbedder(64)
    raw = scan_notes(spark, str(vault))
    videos = parse_notes(raw).select("video_id", "title", "channel", "platform", "url", "duration_ms", "date_saved", "folder", "path")
    rows = [(1, "yt:Kq7Zk2wLm09", "youtube", "header", 0, None, None, "Title one bread"), (2, "yt:Kq7Zk2wLm09", "youtube", "body", 0, 0, 40000, "knead the dough"), (3, "tt:700001", "tiktok", "body", 0, 0, 9000, "fast cars bread")]
    chunks = embed_column(spark.createDataFrame(rows, "chunk_id bigint, video_id string, platform string, chunk_type string, chunk_index int, chunk_start_ms bigint, chunk_end_ms bigint, chunk_text string"), "chunk_text", e)
    frames = spark.createDataFrame([(1, "yt:Kq7Zk2wLm09", "youtube", 10000, "p1")], "frame_id bigint, video_id string, platform string, frame_ms bigint, frame_path string")
    notes = videos.select("video_id", "path").join(raw.select("path", "raw"), "path")
    plain = Library(videos, chunks, frames, e)
    lib = Library(videos, chunks, frames, e, index=text_index.TextIndex(spark, f"{tmp_path}/ix"), notes=notes, files=listing.list_files(spark, str(vault)))
    for query in ("bread dough", "cars"):
        answer = lib.search_response(query, 5)
        assert [(r["chunk_id"], r["score"]) for r in answer["results"]] == [(r["chunk_id"], r["score"]) for r in plain.search(query, 5).orderBy("place").collect()]
        assert answer["total_chunks_searched"] == 3 and answer["query"] == query and answer["sub_queries"] == [] and answer["notes"] == [] and set(answer["ms"]) == {"sync", "embed", "retrieve", "total"}
    assert lib.index.version == 0  # synced once
    assert "error" in lib.search_response("  ") and "error" in lib.search_response("x", platform="nowhere") and lib.search_response("bread", platform="tiktok")["results"][0]["chunk_id"] == 3
    lib.embedder = type("Broken", (), {"version": e.version, "embed": lambda self, text: (_ for _ in ()).throw(RuntimeError("no model"))})()
    assert lib.search_response("bread")["notes"] == ["keyword search only: no model"]
    text = lib.get_transcript("tt:700001").first()
    assert text["transcript"].startswith("## Transcript") and "[0:30] more words of it" in text["transcript"] and text["title"] == "Title two"
    assert lib.find_transcript("https://x/700001?a").first()["video_id"] == "tt:700001" and lib.find_transcript("zz").count() == 0
    video = lib.get_video("tt:700001").first()
    assert video["files"] == ["00000000.jpg", "00007560.jpg", "cover.jpg", "video.md"] and video["video_md_path"].endswith("tiktok/two/video.md")
    assert json.dumps(answer["ms"])
