"""Repeats, rules, PII, near-duplicates and fingerprints against brute force, on awkward rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import imatch, near_dups, pii, repeats, rules
from quarry.llm.common import materialize
from quarry.llm.components import _stars, components

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


# --- op2 ---------------------------------------------------------------------


def removed(texts, length=repeats.LENGTH):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raws for p in range(len(b) - length + 1))
    out = []
    for b in raws:
        cut = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cut[p] += 1
                cut[p + length] -= 1
        gone = np.cumsum(cut[:-1]) > 0
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeats_equal_brute_force(edge, group):
    rows = [r for r in edge_rows() if r[0] != 10]
    got = repeats.remove_repeats(edge.where("doc_id is null or doc_id != 10"), group=group).collect()
    want = [(r[0], *x) for r, x in zip(rows, removed([r[1] for r in rows]))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeats_of_an_empty_table(empty):
    assert repeats.remove_repeats(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=14), min_size=1, max_size=7))
def test_maximal_repeats_equal_brute_force(texts):
    """Members at the anchor 0 of right parts with the same left context: groups are the classes of common prefixes."""
    right = [t.encode() for t in texts]
    left = [b"x"] * len(right)
    got = {(b, d, tuple(sorted(m))) for b, d, m in repeats.maximal_repeats(left, right, [1] * len(right), 1)}
    want = set()
    for i, a in enumerate(right):
        for j, b in enumerate(right):
            if i < j:
                d = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                want.add((1, d, tuple(k for k, c in enumerate(right) if c[:d] == a[:d])))
    assert got == want


def test_left_extensions_part_groups():
    """Left contexts come reversed: ab, ab, cb and nothing."""
    found = {(b, d, tuple(sorted(m))) for b, d, m in repeats.maximal_repeats([b"ba", b"ba", b"bc", b""], [b"xyz", b"xyw", b"xyz", b"q"], [1] * 4, 3)}
    assert found == {(1, 2, (0, 1, 2)), (2, 2, (0, 1)), (1, 3, (0, 2))}


def test_groups_that_cover_nothing():
    """A batch of anchors whose surroundings all differ makes an empty frame that Arrow can read as lists."""
    import pandas as pd
    import pyarrow as pa

    frame = pd.DataFrame({"h": [1, 1, 2], "sig": [1, 2, 3], "n": [1, 1, 1], "lead": [0, 0, 0], "seg": [b"a" * 200, b"b" * 200, b"c" * 200]})
    out = pd.concat(list(repeats._covered(iter([frame]))))
    assert len(out) == 0 and pa.Array.from_pandas(out["spans"], type=pa.list_(pa.int64())).type == pa.list_(pa.int64())


def test_anchors_are_leftmost_least():
    h = np.random.default_rng(0).integers(0, 6, 500).astype(np.uint64) << np.uint64(8)
    at = repeats.anchors(h, 9)
    assert at.tolist() == [i + int(np.argmin(h[i : i + 9])) for i in range(len(h) - 8)]


# --- op3 ---------------------------------------------------------------------


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    window = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if window[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_rule_statistics_equal_brute_force(edge):
    got = rules.apply_rules(edge, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for r in edge_rows():
        c = counts(r[1])
        bad = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((r[0], *c, bad, not bad))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_rules_without_rows_or_labels(edge, empty, labels):
    assert rules.fit_rules(edge, labels) == []
    assert rules.apply_rules(empty, rules.fit_rules(empty, labels)).collect() == []
    kept = rules.filter_docs(edge, [])
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, None, 10}


def test_rules_are_learned_and_ordered(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, len(rules.RATIOS)))
    bad = (x[:, 1] > 0.8) | ((x[:, 4] > 0.7) & (x[:, 9] < 0.3))
    learned = rules.learn_rules(x, bad)
    hit = np.zeros(600, dtype=bool)
    for r in learned:
        hit |= rules._covered(r, x)
    assert 2 <= len(learned) <= 12 and (hit == bad).mean() > 0.95
    frame = spark.createDataFrame([(1, 10, 100, 0)], "id int, n_words bigint, word_chars bigint, n_symbols bigint")
    both = [(rules.Condition(1, True, 0.5),), (rules.Condition(0, True, 5.0), rules.Condition(9, False, 20.0))]
    assert frame.select(rules.verdict(both)).first()[0] == 2 and frame.select(rules.verdict([])).first()[0] is None


# --- op6 ---------------------------------------------------------------------


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark)


PII = [
    "a@b.c_d@e.f x..@a.b @ @a.b a@b", "1.2.3.4.5.6.7.8 999.1.1.1 00001.2.3.255 12345678901234567890.1.1.1", "4111 1111-1111 1111 +1 (800) 555-1234 é4111111111111111", "", None, "+1 +12 + 1", "\U0001f600 x@y.zz \U0001f600 +49 30 1234567",
    "a@b.c" + ".d" * 2000, "9" * 3000, "1 " * 3000, "word" * 3000, "a@b" * 500,
]


def test_base_spans_equal_brute_force(spark, model):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in pii.find_spans(df, *model).select("doc_id", pii._joined("base").alias("b"), pii._joined("spans").alias("s")).collect()}
    for i, t in enumerate(PII):
        assert got[i]["b"] == base_spans(t)
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- (5", max_size=40), min_size=200, max_size=200))
def test_base_spans_of_random_texts(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["b"] for r in pii.find_spans(df, *model).select("doc_id", pii._joined("base").alias("b")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_trees_find_more_and_leave_prose(spark, model):
    texts = ["please call (415) 555-1234 now", "write to bob at example dot com today", "cards 4111111111111111 4111111111111111 here", "in 2024 about 1500 people met at noon", "version 1.2.3 of the order 12345"]
    got = [r["spans"] for r in pii.find_spans(spark.createDataFrame([(t,) for t in texts], "text string"), *model).select(pii._joined("spans").alias("spans")).collect()]
    assert got[0] == "phone:12:26" and got[1] == "email:9:31" and got[2] == "card:6:22,card:23:39" and got[3:] == ["", ""]


SPELT = ["mail jane.doe (at) example.com now", "write to jane[at]example.org", "jane {at} example.org", "jane at example.org", "a@b.c", "a (AT) b dot c", "a at b [dot] c", "meet at noon. then", "a dot b", "at a.b", "", "a@b", "x (at)y.z@w.v"]


def test_gates_lose_no_candidates(spark):
    df = spark.createDataFrame([(t,) for t in SPELT + [t for t, *_ in pii.examples(seed=9, n=400)]], "text string")
    for pattern, gate in zip(pii.WIDE, pii.WIDE_GATE):
        got = df.select("text", pii._matches(F.col("text"), pattern, gate).alias("a"), pii._matches(F.col("text"), pattern, "").alias("b")).collect()
        assert [r["text"] for r in got if r["a"] != r["b"]] == []


def test_a_spelt_at_with_a_plain_dot_is_found(spark, model):
    got = [r["spans"] for r in pii.find_spans(spark.createDataFrame([(t,) for t in SPELT[:2]], "text string"), *model).select(pii._joined("spans").alias("spans")).collect()]
    assert got == ["email:5:30", "email:9:28"]


def test_model_on_unseen_examples(spark, model):
    trees, thresholds = model
    rows = pii.examples(seed=77, n=400)
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id int, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find_spans(df, trees, thresholds).select("doc_id", pii._joined("spans").alias("spans")).collect()}
    hit = [any(int(s.split(":")[1]) < b and a < int(s.split(":")[2]) for s in found[i].split(",") if s) for i, (_, _, a, b, _) in enumerate(rows)]
    good = np.array([r[4] for r in rows]) == 1
    hit = np.array(hit)
    assert hit[good].mean() > 0.75 and hit[~good].mean() < 0.15


def test_redaction_keeps_rows_and_columns(spark, edge, empty):
    rows = spark.createDataFrame([(1, "a x@y.zz b +1 (800) 555-1234", "en", "s", 28), (2, None, None, None, None), (None, "plain", "en", "s", 5)], empty.schema)
    got = {r["doc_id"]: r for r in pii.redact(spark, rows, "").collect()}
    assert got[1]["text"] == "a [EMAIL] b [PHONE]" and got[1]["n_chars"] == 19 and got[2]["text"] is None and got[None]["text"] == "plain"
    assert pii.redact(spark, edge, "").columns == edge.columns and pii.redact(spark, edge, "").count() == edge.count() and pii.redact(spark, empty, "").count() == 0


# --- op7 ---------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def true_classes(rows):
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    bags = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = sum((bags[i] & bags[j]).values())
            if same or both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= near_dups.SIMILARITY:
                up[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = [None] * len(rows)
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (rows[i][0], min(ids) if ids else None, len(g))
    return out


def test_classes_equal_brute_force(edge):
    got = near_dups.near_duplicates(edge).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=key) == sorted(true_classes(edge_rows()), key=key)


def test_a_chain_is_one_class(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        words[20 * i : 20 * i + 20] = [f"z{i}.{k}" for k in range(20)]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def template_family(groups=4, large=250):
    """Texts of one long template each, most with much text of their own; the two with little of it are the only similar ones."""
    rows = []
    for g in range(groups):
        template = [f"t{g}.{k}" for k in range(104)]
        for m in range(large + 2):
            rows.append((1000 * g + m, " ".join(template + [f"o{g}.{m}.{k}" for k in range(10 if m >= large else 30)])))
    return rows


@pytest.mark.parametrize("crowd", [near_dups.CROWD, 40])
def test_similar_texts_in_a_crowded_bucket(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    rows = template_family()
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "class_id", "class_size").collect()
    want = [x for g in range(4) for x in true_classes([r for r in rows if r[0] // 1000 == g])]
    assert sum(n for _, _, n in want) == len(rows) + 2 * 4
    assert sorted(map(tuple, got)) == sorted(want)


def near_copies(n=400, words=300, changed=(1, 9), seed=3):
    """Copies of one text with a few words changed each: pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.integers(0, words, rng.integers(*changed)).tolist():
            own[k] = f"c{i}.{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_a_bucket_of_near_copies_joins(spark):
    rows = near_copies() + [(5000 + i, t.replace("b1 ", "x ")) for i, (_, t) in enumerate(near_copies(60, 40, (2, 5), seed=4))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got)) == sorted(true_classes(rows[:400]) + true_classes(rows[400:]))


def test_partners_are_no_more_than_texts(spark):
    rows = near_copies(200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(near_dups.node_of(F.col("text")).alias("node"), "text")
    now = near_dups.band_keys(docs).select("node", F.explode("keys").alias("key")).withColumn("class", F.col("node"))
    for turn in (0, 1):
        pairs = near_dups._partners(now, turn).collect()
        assert 0 < len(pairs) <= 200 and len({bytes(p["b"]) for p in pairs}) == len(pairs) and all(p["a"] != p["b"] for p in pairs)


def test_prefixes_meet_in_all_similar_pairs(spark):
    rows = near_copies(60, 120, (1, 4)) + [(900 + i, "short text " * i) for i in range(4)]
    df = spark.createDataFrame([(bytearray([i // 256, i % 256]), t) for i, t in rows], "node binary, text string")
    own = {}
    for r in near_dups.prefixes(df.withColumn("class", F.col("node"))).collect():
        own.setdefault(bytes(r["node"]), set()).add(r["key"])
    name = lambda i: bytes([i // 256, i % 256])
    near = 0
    for i, a in rows:
        for j, b in rows:
            x, y = shingles(a), shingles(b)
            both = sum((x & y).values())
            if i < j and both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                near += 1
                assert own[name(i)] & own[name(j)]
    assert near > 100 and max(map(len, own.values())) <= 25


def sized_copies(n=70, words=160, seed=9):
    """Copies of one text with words changed, added and left out: sizes differ, and pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = [f"b{k}" for k in range(words - int(rng.integers(0, 20)))] + [f"d{i}.{k}" for k in range(int(rng.integers(0, 20)))]
        for k in rng.integers(0, len(own), rng.integers(0, 3)).tolist():
            own[k] = f"c{i}.{k}"
        rows.append((i, " ".join(own)))
    return rows + [(900 + i, "short text " * i) for i in range(5)]


def similar(a, b):
    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    return both > 0 and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)


def named_texts(spark, rows):
    return spark.createDataFrame([(bytearray(i.to_bytes(4, "big")), t) for i, t in rows], "node binary, text string").withColumn("class", F.col("node"))


def test_the_smaller_of_two_similar_texts_is_looked_up_by_the_larger(spark):
    rows = sized_copies()
    filed, looked = {}, {}
    for r in near_dups.prefixes(named_texts(spark, rows)).collect():
        i = int.from_bytes(r["node"], "big")
        if r["own"] is not None:
            filed.setdefault(i, set()).add((r["key"], r["own"]))
        looked.setdefault(i, set()).update((r["key"], q) for q in range(r["low"], r["high"] + 1))
    near = sizes = 0
    for i, a in rows:
        for j, b in rows:
            small, large = sum(shingles(a).values()), sum(shingles(b).values())
            if i != j and small <= large and similar(a, b):
                near, sizes = near + 1, sizes + (small < large)
                assert filed[i] & looked[j]
    assert near > 200 and sizes > 100


def family(n, own, words=400):
    """n texts with a template in common and ``own`` words each of their own."""
    return [(i, " ".join([f"t{k}" for k in range(words - own)] + [f"o{i}.{k}" for k in range(own)])) for i in range(n)]


@pytest.mark.parametrize("own,low,high", [(69, 0.69, 0.71), (56, 0.74, 0.76), (46, 0.785, 0.795)])
def test_a_template_family_costs_its_texts_and_not_their_pairs(spark, monkeypatch, own, low, high):
    monkeypatch.setattr(near_dups, "CROWD", 40)
    x, y = (shingles(t) for _, t in family(2, own))
    assert low < sum((x & y).values()) / sum((x | y).values()) < high
    for n in (150, 300):
        texts = named_texts(spark, family(n, own))
        now = texts.select(F.lit(1).cast("bigint").alias("key"), "node", "class", F.octet_length("text").cast("bigint").alias("bytes"))
        rest, sides = near_dups._parted(now, texts.select("node", "text"), [])
        assert rest.count() == 0 and near_dups._looked_up(near_dups._once(sides)).count() <= n


def rows_of_joins(spark, work, kind):
    """Rows that the joins whose plan has ``kind`` put out while work runs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    several = lambda x: [x.apply(i) for i in range(x.size())]
    old = {e.executionId() for e in several(store.executionsList())}
    work()
    bus.waitUntilEmpty(30_000)
    total = 0
    for e in several(store.executionsList()):
        if e.executionId() not in old:
            values = store.executionMetrics(e.executionId())
            for node in several(store.planGraph(e.executionId()).allNodes()):
                if "Join" in node.name() and kind in re.sub(r"#\d+L?", "", node.desc()):
                    ids = [m.accumulatorId() for m in several(node.metrics()) if m.name() == "number of output rows"]
                    total += sum(int(values.apply(i).replace(",", "")) for i in ids if values.contains(i))
    return total


def test_rows_of_buckets_are_joined_to_their_keys_once(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "CROWD", 40)
    n = 160
    docs = spark.createDataFrame(family(n, 69), "doc_id bigint, text string")
    made = rows_of_joins(spark, lambda: near_dups.near_duplicates(docs).collect(), "[key], [key], LeftSemi")
    assert n < made <= near_dups.BANDS * n


def test_equal_buckets_meet_once(spark):
    name = lambda i: bytearray(i.to_bytes(4, "big"))
    rows = [(key, name(i), name(i), 10) for key, members in ((5, range(6)), (3, range(6)), (4, range(5)), (9, [7])) for i in members]
    df = spark.createDataFrame(rows, "key bigint, node binary, class binary, bytes bigint")
    assert sorted(r["key"] for r in near_dups._met(near_dups._once(df)).select("key", "node").distinct().collect()) == [3] * 6 + [4] * 5
    sides = df.withColumn("looks", F.conv(F.hex("node"), 16, 10).cast("int") >= F.when(F.col("key") == 4, 2).otherwise(3)).where("key != 9")
    again = sides.where("key = 4").withColumns({"key": F.lit(8).cast("bigint"), "looks": ~F.col("looks")})
    met = near_dups._looked_up(near_dups._once(sides.unionByName(again)))
    assert sorted(r["key"] for r in met.select("key", "node").distinct().collect()) == [3] * 6 + [4] * 5 + [8] * 5


def test_parted_texts_of_many_sizes_equal_brute_force(spark, monkeypatch):
    for name, value in (("CROWD", 10), ("BLOCK_ROWS", 9)):
        monkeypatch.setattr(near_dups, name, value)
    rows = sized_copies(120)
    group = {i: 0 if i % 4 == 0 and i < 900 else i for i, _ in rows}
    name = lambda i: bytearray(i.to_bytes(4, "big"))
    texts = named_texts(spark, rows).select("node", "text")
    now = spark.createDataFrame([(1, name(i), name(group[i])) for i, t in rows if t], "key bigint, node binary, class binary")
    up = {g: {g} for g in group.values()}
    for i, a in rows:
        for j, b in rows:
            if i < j and similar(a, b) and up[group[i]] is not up[group[j]]:
                one = up[group[i]] | up[group[j]]
                up |= {g: one for g in one}
    roots = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in components(near_dups._finished(now, texts, [])).collect()}
    assert {g: roots.get(g, g) for g in up} == {g: min(up[g]) for g in up}
    assert len(set(map(id, up.values()))) > 5


THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_strings_that_defeat_powers_of_two_are_told_apart(spark):
    from quarry.llm.bpe import RangeHash, string_codes

    buf = np.frombuffer((THUE + MORSE).encode(), dtype=np.uint8)
    h = RangeHash()
    h.load(buf)
    start, end = np.array([0, 1024, 0]), np.array([1024, 2048, 1024])
    assert len(set(h.of(start, end).tolist())) == 2
    assert string_codes(buf, start, end, np.zeros(3, dtype=np.uint64)).tolist() == [0, 1, 0]
    rows = [(1, f"{THUE}\n{MORSE}\n{THUE}"), (2, " ".join([*"abcdefg", THUE, *"abcdefg", MORSE]))]
    got = {r["doc_id"]: r for r in rules.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(got[i]["n_words"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) for i in (1, 2)] == [(counts(t)[0], counts(t)[3], counts(t)[4]) for _, t in rows]
    pair = [(i, " ".join(["w1 w2 w3 w4", w, "w5 w6 w7 w8"])) for i, w in enumerate((THUE, MORSE))]
    assert {r["class_id"] for r in near_dups.near_duplicates(spark.createDataFrame(pair, "doc_id bigint, text string")).collect()} == {0, 1}


@pytest.mark.parametrize("block,crowd", [(256, 4096), (7, 4096), (7, 10), (256, 20)])
def test_finished_buckets_equal_brute_force(spark, monkeypatch, block, crowd):
    """Without partners all is left to the blocks, also those of several blocks, of classes already joined, and of parted crowds."""
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    rows = [(i, " ".join(["a b c d e f g h"] * (i % 3) + [f"w{i % 4}.{k // (1 + i % 5)}" for k in range(40)])) for i in range(40)]
    bags = [shingles(t) for _, t in rows]
    node = lambda i: bytes([i])
    group = [0 if i < 15 else i for i in range(40)]
    now = spark.createDataFrame([(k, bytearray(node(i)), bytearray(node(group[i]))) for k in (1, 2) for i in range(40) if k == 1 or i % 2], "key bigint, node binary, class binary")
    texts = spark.createDataFrame([(bytearray(node(i)), t) for i, t in rows], "node binary, text string")
    up = {g: {g} for g in group}
    for i in range(40):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= near_dups.SIMILARITY and up[group[i]] is not up[group[j]]:
                one = up[group[i]] | up[group[j]]
                up |= {g: one for g in one}
    links = near_dups._finished(now, texts, [])
    roots = {bytes(r["node"])[0]: bytes(r["root"])[0] for r in components(links).collect()}
    assert len(roots) > 4 and {g: roots.get(g, g) for g in group} == {g: min(up[g]) for g in group}


def test_one_of_each(spark, edge, empty):
    kept = near_dups.one_of_each(spark, edge, "").collect()
    assert sorted((r["doc_id"] for r in kept), key=lambda x: (x is None, x or 0)) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 12, None] and len(kept[0]) == 9
    assert near_dups.one_of_each(spark, empty, "").count() == 0 and near_dups.near_duplicates(empty).count() == 0


def test_darts_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(5)
    n, agree, truth = 400, [], []
    for t in range(60):
        a, b = rng.integers(0, 4, n), rng.integers(0, 4, n)
        b = np.where(rng.random(n) < 0.7, a, b)
        element = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 1000)
        e = near_dups.mix(element)
        row = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        sign = near_dups.dart_minhash(np.concatenate([e[a > 0], e[b > 0]]), row, np.concatenate([a[a > 0], b[b > 0]]), 2)
        agree.append((sign[0] == sign[1]).mean())
        truth.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(agree) - np.mean(truth)) < 0.02


def test_components_by_stars(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    name = lambda i: bytes([i])
    df = spark.createDataFrame([(bytearray(name(max(p))), bytearray(name(min(p)))) for p in pairs], "u binary, v binary").distinct()
    small = {bytes(r["node"]): bytes(r["root"]) for r in components(df).collect()}
    now = df
    for _ in range(8):
        now = materialize(_stars(now), "stars")
    large = {bytes(r["u"]): bytes(r["v"]) for r in now.collect()}
    assert {k: v for k, v in small.items() if k != v} == large


# --- op8 ---------------------------------------------------------------------


def spark_hash(*values):
    """Spark's xxhash64 of columns of strings and 4-byte ints."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def brute_print(text, lexicon):
    """(level, hashes) of a text by the lexicon, a set of terms."""
    own = sorted({t for t in re.split(r"[\x20\x09-\x0D]+", text.lower()) if t} & lexicon, key=str.encode)
    level = max(1, min(imatch.LEVELS, int(np.floor(np.log2(len(own) / imatch.KEPT))))) if own else 1
    out = []
    for up in (level, level + 1):
        for j in range(imatch.LEXICONS):
            kept = [t for t in own if spark_hash(t, j) % (1 << up) == 0]
            out.append(spark_hash(j, " ".join(kept)) if kept else 0)
    return (level, out) if any(out) else (0, [spark_hash(text)] * len(out))


def brute_likeness(a, b):
    n = imatch.LEXICONS
    by = [{(level + i // n, i % n): h for i, h in enumerate(hashes)} for level, hashes in (a, b)]
    both = [(by[0][k], by[1][k]) for k in by[0].keys() & by[1].keys()]
    if 0 in (a[0], b[0]) and a[0] != b[0]:
        both = [(0, 1)]  # a whole text and terms have nothing in common
    some = [(x, y) for x, y in both if x or y]
    return sum(x == y for x, y in some) / len(some) if some else 0.0


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_equal_brute_force(spark, edge, parts):
    rows = [(r[0], r[1] or "") for r in edge_rows()] + [(20 + i, (WORD.findall(edge_rows()[0][1])[i] + f" u{i // 2} v{i // 3} ") * (1 + i % 3) + "".join(f"w{k}.{i // 2} " for k in range(4 * i))) for i in range(30)] + [(7, f"hot id {i} {i % 4}") for i in range(40)] + [(None, f"no id {i} {i % 3}") for i in range(20)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lexicon = {r["term"] for r in imatch.lexicon(df).collect()}
    assert len(lexicon) > 50
    want = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, e, b = (brute_print(t, lexicon) for t in (text, edited, after))
        name = lambda p: f"{p[0]:02d}" + "".join(f"{h % (1 << 64):016x}" for h in p[1])
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), name(a), name(e), brute_likeness(a, e), brute_likeness(a, b)))
    got = [tuple(r) for r in imatch.fingerprints(df, parts=parts).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_hot_ids_are_split(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    parts = [r["n"] for r in imatch.with_next(df, imatch._ranges(df, 20)).where("own").groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 4000 and max(parts) < 600 and len(parts) >= 15


def test_fingerprints(edge, empty):
    rows = sorted((r for r in edge_rows() if r[0] is not None and r[0] != 12), key=lambda r: r[0])
    got = sorted(imatch.fingerprints(edge.where("doc_id != 12"), parts=5).collect(), key=lambda r: r["doc_id"])
    assert [r["n_chars"] for r in got] == [len(r[1] or "") for r in rows]
    assert got[0]["fingerprint"] == got[1]["fingerprint"] and got[0]["near_next"] == 1.0
    assert imatch.fingerprints(empty).count() == 0 and imatch.fingerprints(edge).count() == edge.count()
    alone = imatch.fingerprints(edge.where("doc_id = 8")).first()
    assert alone["near_next"] == 1.0


def test_lexicon_band(spark):
    df = spark.createDataFrame([(i, f"Common w{i % 10} u{i}") for i in range(100)], "doc_id bigint, text string")
    got = {r["term"] for r in imatch.lexicon(df, least=0.05, most=0.5).collect()}
    assert got == {f"w{i}" for i in range(10)}
