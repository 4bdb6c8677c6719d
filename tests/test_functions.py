import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "x " + ("double" if isinstance(value, float) else "bigint" if isinstance(value, int) else "string")).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


X = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a session, so X is made when a test runs."""
    global X
    X = F.col("x")


@pytest.mark.parametrize("seconds,label", [(0.0, "0:00.000"), (7.0, "0:07.000"), (65.5, "1:05.500"), (3661.0, "1:01:01.000"), (1.2349, "0:01.235"), (-5.0, "0:00.000"), (math.inf, "0:00.000"), (math.nan, "0:00.000")])
def test_precise_labels(spark, seconds, label):
    assert one(spark, seconds, T.precise_label(X)) == label


def test_clock_and_bracket_labels(spark):
    assert one(spark, 438000, T.bracket_label(X), T.clock_label(X)) == ("[7:18]", "7:18")
    assert one(spark, 3_723_000, T.bracket_label(X), T.clock_label(X)) == ("[62:03]", "1:02:03")
    assert one(spark, None, T.bracket_label(X.cast("bigint")), T.clock_label(X.cast("bigint"))) == (None, None)


@pytest.mark.parametrize("label,strict,tolerant", [("1:05", 65000, 65000), ("1:01:01", 3661000, 3661000), ("42", 42000, 42000), ("1:05.500", None, 65500), ("00:00:01,250", None, 1250), ("a:b", None, None), ("1:2:3:4", None, None), ("", None, None), (None, None, None)])
def test_labels_read_back(spark, label, strict, tolerant):
    assert one(spark, label, T.label_to_ms(X, strict=True), T.label_to_ms(X)) == (strict, tolerant)


@pytest.mark.parametrize("query,expected", [("rye; loaf", '"rye" OR "loaf"'), ("?!", ""), ("", ""), ("Çay s_t 7", '"Çay" OR "s_t" OR "7"')])
def test_match_query(spark, query, expected):
    assert one(spark, query, T.match_query(X)) == expected


URLS = [
    ("https://www.youtube.com/watch?list=L1&v=Zz0_quarry-", "youtube", "Zz0_quarry-"),
    ("http://youtu.be/Zz0_quarry-?si=4", "youtube", "Zz0_quarry-"),
    ("https://m.youtube.com/shorts/Zz0_quarry-", "youtube", "Zz0_quarry-"),
    ("youtube.com/live/Zz0_quarry-#t", "youtube", "Zz0_quarry-"),
    ("https://www.youtube.com/@stones/videos", "youtube", None),
    ("https://tiktok.com/@stones/video/6123456789?x=1", "tiktok", "6123456789"),
    ("https://www.instagram.com/p/Gr4n_te-/?hl=en", "instagram", "Gr4n_te-"),
    ("https://stones.example/a", None, None),
    ("granite", None, None),
]


@pytest.mark.parametrize("url,platform,raw", URLS)
def test_addresses(spark, url, platform, raw):
    found = F.coalesce(F.when(T.platform_of(X) == "youtube", T.youtube_id(X)), F.when(T.platform_of(X) == "tiktok", T.tiktok_id(X)), F.when(T.platform_of(X) == "instagram", T.instagram_code(X)))
    assert one(spark, url, T.platform_of(X), found) == (platform, raw)


def test_tags(spark):
    assert one(spark, '["a, b", c, "", \'d\']', T.tag_list(X)) == ["a, b", "c", "d"]
    assert one(spark, "[]", T.tag_list(X)) == []
    assert one(spark, '["a", "b"]', T.json_strings(X)) == ["a", "b"]
    assert one(spark, '{"a": 1}', T.json_strings(X)) == []
    assert one(spark, "Hi #Foo_Bar #émile #foo", T.hashtags(X)) == ["foo", "émile"]
    assert one(spark, "Hi #Foo_Bar #foo", T.hashtags(X, T.CAPTION_TAG)) == ["foo", "foo_bar"]


def test_yaml_quotes_round_trip(spark):
    assert one(spark, 'a "b" \\ c\nd', T.yaml_quoted(X)) == '"a \\"b\\" \\\\ c d"'
    assert one(spark, 'a "b" \\ c', T.yaml_unquoted(T.yaml_quoted(X))) == 'a "b" \\ c'
    assert one(spark, "bare", T.yaml_unquoted(X)) == "bare"


def test_names_and_titles(spark):
    assert one(spark, 'a/b:c*"d"  e', T.safe_name(X)) == "abcd e"
    assert one(spark, "...", T.safe_name(X)) == ""
    assert one(spark, "", T.folder_name(X, X, F.lit("id1"))) == "id1"
    assert one(spark, "#a @b Great day. More text #c\nsecond", T.caption_title(X, F.lit("none"))) == "Great day."
    assert one(spark, "#only #tags", T.caption_title(X, F.lit("none"))) == "none"
    assert len(one(spark, "word " * 40, T.caption_title(X, F.lit("none")))) <= 80


def test_text_measures(spark):
    assert one(spark, "  ", T.approx_tokens(X)) == 0
    assert one(spark, "a" * 70, T.approx_tokens(X)) == 20
    assert one(spark, "The, QUICK é1 x", T.search_tokens(X)) == ["the", "quick", "é1"]
    assert one(spark, "a  B\n c", T.normalized(X)) == "a b c"
    assert one(spark, "best of ai tools", T.keyword_weight(X, F.array(F.lit("best"), F.lit("ai"), F.lit("ool")))) == 5
    assert one(spark, "best of ai tools", T.keyword_weight(X, F.array(F.lit("best"), F.lit("zz")))) == 0
    assert one(spark, "a &amp;lt; b&nbsp;c", T.html_unescaped(X)) == "a < b c"
    assert one(spark, "one two three four", T.looks_compound(X)) is True
    assert one(spark, "one", T.looks_compound(X)) is False
    for query, expected in (("tea sowie milk", True), ("tea, milk", True), ("tea,milk", False), ("tea; milk", True), ("why tea?", True), ("tea?milk", False), ("tea versus milk", False), ("Tea UND milk", True), ("sandoro", False), ("", False)):
        assert one(spark, query, T.looks_compound(X)) is expected
    assert one(spark, "/v/a/b.md", T.relative_path(X, F.lit("/v/"))) == "a/b.md"
    assert one(spark, "1080p60", T.first_height(X)) == 1080
    assert one(spark, "2024-05-06T07:08:09Z", T.iso_to_ms(X)) == 1714979289000
    assert one(spark, "soon", T.iso_to_ms(X)) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(V.norm(F.col("a")), V.cosine(F.col("a"), F.col("z")), V.normalized(F.col("a")), V.normalized(F.col("z")), V.l2(F.col("a"), F.col("z"))).first()
    assert tuple(row) == (5.0, 0.0, [0.6, 0.8], [0.0, 0.0], 5.0)
    blob = df.select(V.from_blob(V.to_blob("a"))).first()[0]
    assert blob == [3.0, 4.0]
    bits = spark.createDataFrame([([1.0] * 64,), ([-1.0] * 63 + [1.0],)], "v array<float>").select(V.sign_bits(F.col("v"))).collect()
    assert [r[0] for r in bits] == [-1, -(1 << 63)]


def test_centroid_skips_other_widths(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [9.0])], "k string, v array<double>")
    got = V.centroid(df, ["k"], "v", 2).first()["v"]
    assert got == pytest.approx([math.sqrt(0.5)] * 2)


def test_wrapping_equals_a_loop(spark):
    import random

    from quarry.operators.chunking import markdown, wrap
    from quarry.operators.select import platform_flag

    rng = random.Random(8)
    texts = [" ".join("\u00e9x"[i % 2] * rng.randrange(1, 30 if i % 9 else 120) for i in range(rng.randrange(0, 60))) for _ in range(40)] + ["", "  ", "a", "x" * 200, "a " + "y" * 81 + " b", "z" * 80 + " c", "\U0001f600 " * 100, "word " * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.wrapped(F.col("t")).alias("lines"), T.markdown_page(F.lit("T"), F.array("t")).alias("page")).collect():
        assert r["lines"] == wrap(texts[r["i"]]) and r["page"] == markdown("T", [texts[r["i"]]])
    assert [platform_flag(x) for x in (" TikTok ", "", None)] == ["tiktok", None, None]
    ids = spark.createDataFrame([(n, list(range(n))) for n in (0, 3, 256, 300)], "n int, ids array<int>").select("n", T.truncated_ids(F.col("ids")).alias("x")).collect()
    assert all(r["x"] == (list(range(r["n"])) if r["n"] <= 256 else [*range(255), r["n"] - 1]) for r in ids)
    durations = spark.createDataFrame([(5.0, 7.0), (9.0, 2.0), (4.0, None), (4.0, float("nan")), (4.0, float("inf")), (None, 3.0)], "a double, b double").select(T.longest_ms(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in durations] == [7.0, 9.0, 4.0, 4.0, 4.0, 3.0]
