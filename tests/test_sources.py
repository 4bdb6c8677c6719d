import json
import struct

import pytest
from pyspark.sql import functions as F

from quarry.operators.chunking import all_chunks
from quarry.sources import captions, media, sinks, vault
from quarry.streaming import ingest

NOTE = """---
title: "A \\"quoted\\" title"
platform: youtube
video_id: q7Zk2w
url: https://www.youtube.com/watch?v=q7Zk2w
channel: "Chan: nel"
duration: "1:05"
date_saved: 2024-05-06T07:08:09Z
tags: ["x, y", z]
---

## Description

First line.

## Transcript

[0:00] hello there
[0:05] general
_No speech detected._
[bad] nothing
[1:05.500] end

## On-screen text

[0:07] SLIDE
"""
BROKEN = ["no frontmatter", "---\ntitle: x\n", "---\ntitle: x\n---\n", "---\n:::\n::\n---\n", "---", "", "\x00\x01\x02"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    good = top / "youtube" / "Chan - A title"
    good.mkdir(parents=True)
    (good / "video.md").write_text(NOTE)
    for name in ("00000000.jpg", "00438000.jpg", "5.jpg", "cover.jpg"):
        (good / name).write_bytes(b"x")
    for i, text in enumerate(BROKEN):
        (top / "tiktok" / f"b{i}").mkdir(parents=True)
        (top / "tiktok" / f"b{i}" / "video.md").write_text(text)
    old = top / "older"
    old.mkdir()
    (old / "video.md").write_text("---\ntitle: Old\npost_id: p1\nplatform: tiktok\nauthor: me\nhashtags:\n  - a\n  - b\nduration: 7\n---\n## Caption\nhi\n")
    return str(top)


def test_notes(spark, root):
    got = {r["video_id"]: r for r in vault.parse_notes(vault.scan_notes(spark, root)).collect()}
    assert set(got) == {"yt:q7Zk2w", "tt:p1"}
    r = got["yt:q7Zk2w"]
    assert (r["title"], r["channel"], r["duration_ms"], r["tags"], r["description"]) == ('A "quoted" title', "Chan: nel", 65000, ["x, y", "z"], "First line.")
    assert [(s["ms"], s["text"]) for s in r["transcript"]] == [(0, "hello there"), (5000, "general"), (65500, "end")]
    assert [(s["ms"], s["text"]) for s in r["screen"]] == [(7000, "SLIDE")]
    assert (got["tt:p1"]["tags"], got["tt:p1"]["channel"], got["tt:p1"]["description"]) == (["a", "b"], "me", "hi")


def test_chunks_of_notes(spark, root):
    videos = vault.parse_notes(vault.scan_notes(spark, root))
    rows = all_chunks(videos, vault.note_segments(videos)).collect()
    kinds = sorted((r["video_id"], r["chunk_type"]) for r in rows)
    assert kinds == [("tt:p1", "header"), ("yt:q7Zk2w", "body"), ("yt:q7Zk2w", "frame_text"), ("yt:q7Zk2w", "header")]
    body = next(r for r in rows if r["chunk_type"] == "body")
    assert body["chunk_text"] == "[0:00] hello there\n[0:05] general\n[1:05] end" and (body["chunk_start_ms"], body["chunk_end_ms"]) == (0, 65500)
    assert "Timestamp: [0:00 – 1:05]" in body["embedding_input"]
    assert "Source: on-screen text" in next(r for r in rows if r["chunk_type"] == "frame_text")["embedding_input"]


def test_frames_and_manifest(spark, root, tmp_path):
    assert sorted(r["frame_ms"] for r in vault.list_frames(spark, root).collect()) == [0, 5, 438000]
    assert sorted(r["frame_ms"] for r in vault.list_frames(spark, root, least_digits=8).collect()) == [0, 438000]
    rows = vault.read_manifest(spark, root)
    assert {r["videoID"] for r in rows.collect()} == {"q7Zk2w", "p1"}
    sinks.write_manifest(rows, f"{tmp_path}/out")
    text = "".join(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect())
    entries = json.loads(text)
    assert [e["videoID"] for e in entries] == ["q7Zk2w", "p1"] and entries[0]["tags"] == ["x, y", "z"]
    for kind, body in (("bare", text), ("held", json.dumps({"videos": entries}))):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "manifest.json").write_text(body)
        assert {r["videoID"] for r in vault.read_manifest(spark, f"{tmp_path}/{kind}").collect()} == {"q7Zk2w", "p1"}


@pytest.mark.parametrize("garbage", ["", "text", "{", '{"a": 1}', "[1, 2, 3]", "x" * 10000, "﻿[]"])
def test_manifest_survives(spark, tmp_path, garbage):
    (tmp_path / "manifest.json").write_text(garbage)
    assert vault.read_manifest(spark, str(tmp_path)).count() == 0


def test_note_round_trip(spark):
    df = spark.createDataFrame([('A "b"', "youtube", "id1", "u", "c", "0:10", "2024", ["t, u"], "desc", "", [("0:00", "hi")])], "title string, platform string, raw_id string, url string, channel string, duration string, date_saved_text string, tags array<string>, description string, summary string, segments array<struct<label:string,text:string>>")
    raw = df.select(sinks.compose_note().alias("raw"), F.lit("f").alias("folder"), F.lit("p").alias("path"), F.lit(0).cast("bigint").alias("mtime_ms"))
    back = vault.parse_notes(raw).first()
    assert (back["title"], back["raw_id"], back["tags"], back["description"]) == ('A "b"', "id1", ["t, u"], "desc") and back["transcript"][0]["text"] == "hi"


def test_captions(spark):
    def cues(f, body):
        got = spark.createDataFrame([(body,)], "x string").select(f(F.col("x"))).first()[0]
        return None if got is None else [tuple(c) for c in got]

    vtt = "WEBVTT\n\n1\n00:00:01.500 --> 00:00:02.000 align:start\nHello\nworld\n\nbad --> x\nno\n\n00:03.000 --> 00:04.000\n\n"
    assert cues(captions.webvtt, vtt) == [(1500, "Hello world")]
    assert cues(captions.srt, "1\r\n00:00:01,500 --> 00:00:02,000\r\nHi\r\n\r\n") == [(1500, "Hi")]
    assert cues(captions.utterances, '{"utterances": [{"text": " a ", "start_time": 12}, {"text": ""}, {"text": "b"}]}') == [(12, "a"), (0, "b")]
    assert cues(captions.utterances, "nonsense") is None


def test_pages(spark):
    html = '<script id="H" type="application/json">{"a": {"b": [{"c": "x"}]}}</script><script type="application/json">{"q": [1, {"shortcode": "S", "like_count": "7"}]}</script>'
    df = spark.createDataFrame([(html,), ("<p>",), (None,)], "html string")
    got = captions.deep_search(df.withColumn("v", captions.hydration(F.col("html"), "H", "$.a.b[0].c")), "html", "shortcode").collect()
    assert [r["v"] for r in got] == ["x", None, None] and json.loads(got[0]["found"])["shortcode"] == "S" and got[1]["found"] is None
    post = spark.createDataFrame([(got[0]["found"],)], "j string").select(captions.post_fields(F.col("j")).alias("p")).first()["p"]
    assert (post["code"], post["likes"], post["views"]) == ("S", 7, None)
    panel = '<transcript-segment-view-model><div>1:02</div><span>Hello &amp; you</span></transcript-segment-view-model>'
    assert [tuple(s) for s in spark.createDataFrame([(panel,)], "h string").select(captions.rendered_segments(F.col("h"))).first()[0]] == [("1:02", "Hello & you")]
    player = '{"streamingData": {"formats": [{"itag": 1, "approxDurationMs": "5000"}], "adaptiveFormats": [{"itag": 2, "approxDurationMs": "7000"}]}}'
    p = spark.createDataFrame([(player,)], "x string").select(captions.player_formats(F.col("x")).alias("p")).first()["p"]
    assert ([f["itag"] for f in p["formats"]], p["progressive"], p["length_ms"]) == ([1, 2], 1, 7000)


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_media_boxes(spark):
    refs = b"".join(struct.pack(">III", size, duration, 0) for size, duration in ((100, 1000), (200, 2000)))
    sidx = box(b"sidx", struct.pack(">IIIIIHH", 0, 1, 1000, 500, 16, 0, 2) + refs)
    assert media.segment_index(box(b"ftyp", b"abcd") + sidx) == [(12 + len(sidx) + 16, 100, 500.0, 1000.0), (12 + len(sidx) + 116, 200, 1500.0, 2000.0)]
    tfhd = box(b"tfhd", struct.pack(">IIII", 0x20008 | 0x20, 1, 40, 0x01010000))
    tfdt = box(b"tfdt", struct.pack(">II", 0, 90))
    trun = box(b"trun", struct.pack(">IIiI", 0x000205 | 0x800, 2, 8, 0x02000000) + struct.pack(">IIII", 11, 5, 22, 6))
    moof = box(b"moof", box(b"mfhd", bytes(8)) + box(b"traf", tfhd + tfdt + trun))
    assert media.fragment_samples(moof, 1000) == [(1008, 11, 90, 95, 40, True), (1019, 22, 130, 136, 40, False)]
    df = spark.createDataFrame([("a", bytearray(sidx)), ("b", bytearray(sidx[:20])), ("c", bytearray(b""))], "path string, content binary")
    assert [(r["path"], r["seq"], r["size"]) for r in media.segment_rows(df).collect()] == [("a", 0, 100), ("a", 1, 200)]
    assert media.sample_rows(spark.createDataFrame([("m", bytearray(moof))], "path string, content binary")).count() == 2


def test_streaming_ingest(spark, root, tmp_path):
    out = f"{tmp_path}/chunks"
    for _ in range(2):  # the second run has no new note
        ingest.ingest(ingest.note_stream(spark, root), out, f"{tmp_path}/state").awaitTermination()
    rows = ingest.current_chunks(spark, out).collect()
    assert sorted({r["video_id"] for r in rows}) == ["tt:p1", "yt:q7Zk2w"] and len(rows) == 4


def test_queued_links(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"url": "https://youtu.be/dQw4w9WgXcQ", "source": "s", "at": "2024-01-01T00:00:00Z"}\n' * 2 + '{"url": "https://example.com", "source": "s", "at": "2024-01-01T00:00:00Z"}\n')
    links = spark.readStream.schema("url string, source string, at timestamp").json(f"{tmp_path}/in")
    q = ingest.queued_links(links).writeStream.format("memory").queryName("links").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["platform"] for r in spark.table("links").collect()] == ["youtube"]
