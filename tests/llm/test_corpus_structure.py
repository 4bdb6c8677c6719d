"""Main text, source divergence and conversation tries: hand-written pages, SQL, brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import divergence, mincut, tries
from quarry.llm.page_blocks import read_page

from .conftest import DOCS, prose

# --- op11 ----------------------------------------------------------------------

READERS = "".join(f"<div class='comment'><div class='content'><p>Reader {i} says that this was a very good article, and I think so too, because of many things.</p></div></div>" for i in range(12))
#: Written by hand, none by the generator that the classifier is fitted on: (html, text).
PAGES = {
    "semantic": (
        """<!doctype html><html><head><title>T</title><meta name=x></head><body class="has-sidebar"><header><a href=/>The Daily</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>World</a></ul></nav></header>
        <div class="cookie-banner"><p>We use cookies to improve your visit. <button>Accept</button></p></div>
        <main><article><header><h1>A bridge reopens</h1><p>It took three years.</p></header><p>The old bridge, closed since spring, was opened <em>yes</em>terday.</p>
        <aside class="related"><h3>Read also</h3><ul><li><a href=/c>Another story</a></ul></aside>
        <figure><img src=x><figcaption>The bridge at dawn</figcaption></figure>
        <h2>Costs</h2><ul><li>Steel: 4 million<li>Paint</ul><table><tr><td>Year<td>2020</table>
        <p>Short.</p><blockquote>&ldquo;We are glad&rdquo;, they said.</blockquote><pre>a\n b</pre>
        <form action=/s><label>Your e-mail</label><input><button>Go</button></form><footer>Filed under: bridges</footer></article></main>
        <section id="comments"><h2>2 comments</h2><article class="comment"><p>I crossed it today and it is a very nice bridge, thank you all.</p></article></section>
        <aside><h2>Most read</h2><p>Some long teaser text that says what happened in the town yesterday evening.</p></aside>
        <footer>&copy; 2024 The Daily. All rights reserved.</footer><script>document.write("<p>no</p>")</script></body></html>""",
        "A bridge reopens\nIt took three years.\nThe old bridge, closed since spring, was opened yesterday.\nThe bridge at dawn\nCosts\nSteel: 4 million\nPaint\nYear\n2020\nShort.\n“We are glad”, they said.\na b",
    ),
    "divs named by what they hold": (
        """<html><body><div id="wrapper" class="right-sidebar"><div class="topbar"><div>Call us 555</div></div><div id="menu"><a href=1>One</a> <a href=2>Two</a></div>
        <div class="post-content"><h1>How to bake</h1><div>First you take the flour and mix it with water, as described.<br>Then you wait.</div><div class="ad-slot">Buy our flour now! It is the best flour that you can find.</div><p>Then you bake for an hour. Done!</p></div>
        <div class="sidebarRight"><h3>About me</h3><p>I am a baker who writes about bread, every day and in all weathers.</p></div>
        <div class="comments-area"><div class="comment-body"><p>Great recipe, I tried it twice and it worked both times, thanks.</p></div></div><div class="site-footer"><p>Powered by bread</p></div></div></body></html>""",
        "How to bake\nFirst you take the flour and mix it with water, as described. Then you wait.\nThen you bake for an hour. Done!",
    ),
    "no hints": (
        """<html><body><table><tr><td><a href=1>Home</a></td><td><a href=2>News</a></td><td><a href=3>Sport</a></td></tr></table><div><h1>The storm of the year</h1><p>A storm went over the coast during the night and broke many trees, the mayor said on Monday.</p><p>Nobody was hurt, but several roads remain closed until further notice.</p><p>Wow.</p><p>The storm was the strongest since records began, according to the weather service.</p></div><div><a href=4>Imprint</a> | <a href=5>Privacy</a> | © 2020</div></body></html>""",
        "The storm of the year\nA storm went over the coast during the night and broke many trees, the mayor said on Monday.\nNobody was hurt, but several roads remain closed until further notice.\nWow.\nThe storm was the strongest since records began, according to the weather service.",
    ),
    "a form around the page": (
        """<body><form id="aspnetForm"><div class="nav"><a href=1>A</a></div><div class="article"><h1>Title here</h1><p>Text of the article, which is long enough to be seen as such.</p><p>Another paragraph follows it, and ends.</p></div><div class=footer>Bye</div></form></body>""",
        "Title here\nText of the article, which is long enough to be seen as such.\nAnother paragraph follows it, and ends.",
    ),
    "notices": (
        """<body><nav>Menu</nav><div class="notice">This site will be down on Sunday for maintenance. Please come back on Monday.</div><div class="alert alert-info"><p>Please update your browser.</p></div><article><h1>X</h1><p>Y</p><p>z &amp; w&nbsp;v &lt;tag&gt;</p><div class="newsletter-signup"><p>Get our stories in your inbox every week.</p></div><p>end</p></article><section class="comments"><ol><li>First!</li><li>Nice article, I liked the part about y very much indeed.</li></ol></section></body>""",
        "X\nY\nz & w v <tag>\nend",
    ),
    "roles": (
        """<body><div role="banner">Logo</div><div role="navigation"><a>x</a></div><div role="main"><section><h1>Deep</h1><section><h2>Sub</h2><p>One.</p><p>Two two.</p></section></section></div><div role="complementary"><p>Side things that run long enough to look like prose, but are not.</p></div><div role="contentinfo">c</div></body>""",
        "Deep\nSub\nOne.\nTwo two.",
    ),
    "hidden": ('<article><h1>A</h1><p>Text one here.</p><div style="display:none"><p>secret text</p></div><p hidden>also hidden words</p><p>Text two.</p></article>', "A\nText one here.\nText two."),
    "end tags left out": ("<body><nav><ul><li><a>x</a><li><a>y</a></nav><article><h1>T<p>One<p>Two <b>bold<p>Three</b></article><footer>f", "T\nOne\nTwo bold\nThree"),
    "markup left open": ('<p>a</p><article><p><b>Head.<br><p>Next one.</p><p title="1 > 0">A < b and c &lt d.<!-- no --><!--> yes.</p><svg/><p>last', "Head.\nNext one.\nA < b and c < d. yes.\nlast"),
    "bare": ("Just a line of text without any markup at all.", "Just a line of text without any markup at all."),
    "cut off": ("<article><p>Hello there, this page was cut off in the mid<a hr", "Hello there, this page was cut off in the mid"),
    "script is no text": ('<article><p>Before it.</p><script>if (a < b) { x = "</p>"; }</script><style>p{}</style><noscript><p>Turn it on</noscript><p>After it.</p><select><option>1<option>2</select><p>End.</p></article>', "Before it.\nAfter it.\nEnd."),
    "comments longer than the article": (f"<body><div id=page><div class='entry-content'><h1>T</h1><p>Short article text stands here.</p></div><div class='comments'>{READERS}</div></div></body>", "T\nShort article text stands here."),
    "comments in the article": (f"<body><article><h1>T</h1><p>Short article text stands here.</p><section id='comments-section'>{READERS}</section></article></body>", "T\nShort article text stands here."),
    "names written as one": (
        """<body><div id='topnav'><a href=1>A</a><a href=2>B</a></div><div class='cookiebar'>This site stores data on your machine. Fine.</div><div class='adbox'>Buy it now, it is the best there is.</div><article><h1>T</h1><p>Text here stands.</p><div class='adslot'>Buy more of it.</div><p>More text.</p></article><div id='leftsidebar'><p>Something about the author, who lives in a town.</p></div><div class='usercomments'><p>Nice, I like it very much indeed.</p></div><div id='pagefooter'>Bye now</div></body>""",
        "T\nText here stands.\nMore text.",
    ),
    "an article named commentary": ("<body><nav><a href=1>x</a></nav><div class='commentary'><h1>On things</h1><p>This is a commentary on things that happened yesterday.</p><p>It has two paragraphs, and ends.</p></div></body>", "On things\nThis is a commentary on things that happened yesterday.\nIt has two paragraphs, and ends."),
    "several posts": ("<body><header><h1>Blog of X</h1><p>All about things that matter to us.</p></header><div class='post'><h2>Post title</h2><p>Post text is here, and it is good.</p></div><div class='post'><h2>Other title</h2><p>Other text is here as well.</p></div></body>", "Post title\nPost text is here, and it is good.\nOther title\nOther text is here as well."),
    "a page laid out by a table": ("<body><table><tr><td class='menu'><a href=1>Home</a><br><a href=2>Links</a></td><td class='content'><h1>Old page</h1><p>Old pages were made of tables, and this is one of them.</p><p>It still works.</p></td></tr></table></body>", "Old page\nOld pages were made of tables, and this is one of them.\nIt still works."),
    "links and small print in the article": ("<body><nav><a href=1>x</a></nav><article><h1>Links</h1><p><a href=1>All of this paragraph is one link to somewhere else.</a></p><ul><li><a href=2>One</a></li><li><a href=3>Two</a></li></ul><p>© 2020 is what the stone says, and all rights reserved.</p></article></body>", "Links\nAll of this paragraph is one link to somewhere else.\nOne\nTwo\n© 2020 is what the stone says, and all rights reserved."),
    "menu only": ("<nav><a href=1>a</a></nav>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_hand_written_pages(name):
    source, text = PAGES[name]
    assert mincut.main_text(source, mincut.fitted()) == text


def test_main_text_of_unseen_made_pages():
    made = mincut.sample_pages(150, seed=987)
    right = sum(mincut.main_text(source, mincut.fitted()) == "\n".join(t for t, keep in truth if keep) for source, truth in made)
    assert right >= 0.95 * len(made)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 5)), max_size=14))
def test_minimum_cut_costs_least(lean, edges):
    n = len(lean)
    edges = [(u % n, v % n, c) for u, v, c in edges]

    def cost(x):
        return sum(abs(w) for w, k in zip(lean, x) if (w > 0) != k and w) + sum(c for u, v, c in edges if x[u] != x[v])

    every = list(itertools.product([False, True], repeat=n))
    least = min(map(cost, every))
    got = mincut.minimum_cut(lean, edges)
    assert cost(got) == least and sum(got) == max(sum(x) for x in every if cost(x) == least)


@pytest.mark.parametrize("source", ["<b>" * 50_000 + "x", "<div>" * 20_000 + "x", "<p>a" * 20_000, "<a " * 50_000, '<a ="' * 30_000 + ">", "<!--" * 50_000, "<li><a href=x>k</a>" * 20_000, "<i><b>" * 20_000 + "</i>" * 20_000, "<article><p>" + "word " * 300_000])
def test_long_and_broken_pages_end(source):
    mincut.main_text(source, mincut.fitted())


def test_an_unsure_block_goes_with_what_it_stands_among():
    lines = "".join(f"<p>This is paragraph number {i} of the article, and it goes on.</p>" for i in range(6))
    weights = mincut.fitted()
    alone = read_page("<div><p>Hm</p></div>")
    odds = (mincut.features(alone, *mincut.states(alone)) @ list(weights))[0]
    assert "Hm" in mincut.main_text(f"<div>{lines}<p>Hm</p>{lines}</div>", weights).split("\n") and odds < 2


def test_op11_over_awkward_pages(spark, tmp_path):
    rows = [(i, f"http://h/{i}", source, "x") for i, (source, _) in enumerate(PAGES.values())] * 2 + [(None, None, "<article><p>Null id here.</p></article>", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    out = mincut.op11_main_text(spark, str(tmp_path))
    want = [(i, f"http://h/{i}", text, len(text)) for i, (_, text) in enumerate(PAGES.values())] * 2 + [(None, None, "Null id here.", 13)]
    assert out.columns == ["page_id", "url", "text", "n_chars"] and sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert mincut.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        mincut.extract_main_text(out, "text", ("page_id", "text"))


# --- op12 ----------------------------------------------------------------------


def sql_rows(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    return sorted(con.execute(divergence.SQL).fetchall())


def test_divergence_equals_sql(spark, edge, empty):
    rng = random.Random(3)
    words = [prose(40, 60).split()[i] for i in range(40)] + ["ÄÖü", "naïve", "日本"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))) + rng.choice([" A-Z's x1y", "", "\U0001f600é"]), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "a", "b", "é", None]), 1) for i in range(150)]
    rows += [(900, "alone", "xx", s, 1) for s in ("p", "q", "q")] + [(901, None, "en", "new", None)]
    docs = spark.createDataFrame(rows, DOCS).unionByName(edge.select(*empty.columns))
    got = divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, got.collect()))
    assert got == sql_rows(spark, docs)
    assert ("xx", "p", "pair", "q", 0, 1) in got  # a language without a kept term
    assert divergence.source_divergence(empty).count() == 0


def test_divergence_is_exact_for_large_counts(spark):
    n = 3_000_000_000_000
    row = spark.createDataFrame([(n, 5 * n)], "c long, t long").select(divergence.smoothed(F.col("c"), F.col("t"), F.lit(7).cast("long"))).first()[0]
    assert row == 1 + 10**9 * (n + 2) // (5 * n + 14)


# --- op13 ----------------------------------------------------------------------

NONE = hashlib.sha256().hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda t: t[:2])
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = tuple(t[2:] for t in convs.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in nodes if p), Counter(), Counter()
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if ends[p] else NONE) for p, m in nodes.items()
    )


def trie_rows(spark, rows, kind="conv_id long, turn long, role string, text string"):
    out = tries.prefix_trie(spark.createDataFrame(rows, kind))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def conversations(seed, convs, turns=9):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        fork = rng.randrange(0, 5)
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > fork else "user", f"turn {t} " + (str(rng.randrange(3)) if t > fork else "same") + "é\U0001f600" * (t % 3)))
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations(1, [*range(0, 120), *range(250, 270), -5, -100, -150, 10**12])
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_awkward_conversations(spark):
    rows = [(0, None, None, None), (0, 3, "user", None), (0, 5, None, ""), (1, 1, "user", "x"), (7, 0, "a", "b"), (7, None, "z", "first"), (None, 0, "user", "of none"), (203, 0, "", "only"), (300, 0, "u", "ab"), (301, 0, "ua", "b")]
    rows += [(c, 0, "user", "hello") for c in range(400, 460)]  # copies, some of which end at the root
    rows += [(500, 1, "user", "twice"), (500, 1, "user", "twice"), (500, 2, "user", "twice")]
    assert trie_rows(spark, rows) == brute_trie(rows)
    wide = [(*r, 1, "x", 5) for r in rows]
    assert trie_rows(spark, wide, "conv_id long, turn long, role string, text string, depth int, k1 string, part int") == brute_trie(rows)
    assert trie_rows(spark, [(None, 1, "user", "x")]) == [] and trie_rows(spark, []) == []
    assert trie_rows(spark, [(99, 0, "user", "x" * 400_000)]) == brute_trie([(99, 0, "user", "x" * 400_000)])


def test_one_long_conversation_is_dealt_over_tasks(spark, monkeypatch):
    """A third of all rows are one conversation's; segments of ids are cut small."""
    monkeypatch.setattr(tries, "SEGMENT", 7)
    monkeypatch.setattr(tries, "ROWS", 50)
    rows = conversations(5, range(700, 790), 12) + [(700, 100 + t, "user", f"more {t % 5}") for t in range(300)] + [(c, 0, "user", "the same") for c in range(2000, 2060)]
    seen = []
    real = tries.materialize

    def spy(df, name):
        out = real(df, name)
        if name == "turns":
            seen.append(out.where((F.col("conv_id") == 700) & F.col("opens").isNull()).select("part").distinct().count())
        return out

    monkeypatch.setattr(tries, "materialize", spy)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or so few rows would be put into one task
    try:
        assert trie_rows(spark, rows) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert seen[0] > 1
