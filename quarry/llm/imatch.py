"""I-Match fingerprints: terms of middling document frequency, hashed by randomised lexicons.

Document frequencies are counted over all texts.  The lexicon keeps terms that
occur in at least ``LEAST_SHARE`` and at most ``MOST_SHARE`` of documents, a
band of inverse document frequency; its size is at most the mean number of
distinct terms of a document over ``LEAST_SHARE``, whatever the corpus, and is
checked before it is broadcast (beyond ``BROADCAST_TERMS`` it is joined by
shuffle).  Randomised lexicon j of level l keeps a term of the band with
probability 2**-l.  A text's level depends on its number of terms, so that
each of its lexicons keeps few of them, enough to tell texts apart and so few
that an edit spares some lexicons whole; its distinct terms, sorted, are hashed
once for each of ``LEXICONS`` lexicons of its level and of the next, so texts
of somewhat different length share a level.

Only built-in functions are used.  The documents are dealt once, by ranges of
doc_id and a hash of the text; each range also gets the first row of the next,
so a document's successor is in its own task, and term lists are gathered there
again.

Defined results: a null text counts as empty; documents are ordered by doc_id
(null first), then by a hash of the text; the last one's successor is the
first; a single document succeeds itself; repeated rows are rows of their own
(rows alike in doc_id and text lie in one range); an empty table gives an empty
result; other columns are ignored.  A text without a lexicon term has a
fingerprint of its whole text, so it is like equal texts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, tidy

#: The band: terms in at least one of 5,000 and at most one of 20 documents.
LEAST_SHARE, MOST_SHARE = 1 / 5000, 1 / 20
BROADCAST_TERMS = 4_000_000
#: Lexicons of each level; a text's level leaves each at least so many terms on average, and less than twice as many.
LEXICONS, KEPT = 10, 1.5
#: The last level that four bits can say, less the next one.
LEVELS = 14
BLANKS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct lower-case terms of a text; the empty string is none of them."""
    return F.array_distinct(F.filter(F.split(F.lower(text), BLANKS), lambda t: t != ""))


def lexicon(docs: DataFrame, *, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, kept): terms of the band; four bits of kept for each lexicon say the last level that keeps the term."""
    n = docs.count()
    counted = docs.select(F.explode(terms(tidy(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    bits = F.lit(0).cast("long")
    for j in range(LEXICONS):
        # Zeros at the end of a hash: l or more of them with probability 2**-l.
        tail = F.xxhash64("term", F.lit(j)).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(0x10000))
        level = F.least(F.bit_count(tail.bitwiseAND(-tail) - 1), F.lit(LEVELS + 1))
        bits = bits + F.shiftleft(level.cast("long"), 4 * j)
    low, high = max(2, least * n), max(2, most * n)
    return counted.where((F.col("df") >= low) & (F.col("df") <= high)).select("term", bits.alias("kept"))


def _ranges(docs: DataFrame, parts: int) -> tuple[int, dict[int, int]]:
    """(ranges of rows without doc_id, ids that split the others about evenly into parts, in order, each with its number of parts' rows)."""
    values = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.lit(None)
    rows, none, found = docs.agg(F.count("*"), F.sum(F.col("doc_id").isNull().cast("long")), values).first()
    cuts: dict[int, int] = {}
    for v in sorted(found or ()):
        cuts[v] = cuts.get(v, 0) + 1
    return max(1, round(parts * (none or 0) / max(1, rows))), cuts


def with_next(docs: DataFrame, ranges: tuple[int, dict[int, int]]) -> DataFrame:
    """docs (doc_id, text) as (part, at, doc_id, text, own): dealt by ranges of doc_id and hash, each range in order of at,
    with copies (own = false) of the next range's first rows at its end."""
    spark = docs.sparkSession
    first, times = ranges
    cuts = list(times)
    hot = {v: k for v, k in times.items() if k > 1}
    most = max(hot.values(), default=1)

    # Binary search, so that a row costs the logarithm of the number of ranges.
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    # The hash is uniform and orders the rows of an id, so even steps of it split an id that fills several ranges.
    step = lambda k: F.least(k - 1, F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * k)).cast("int")
    inner = F.lit(most - 1)
    if hot:
        k = F.try_element_at(F.create_map(*(F.lit(x) for item in hot.items() for x in item)), F.col("doc_id"))
        inner = F.when(k.isNotNull(), step(k)).otherwise(inner)
    placed = docs.withColumn("h", F.xxhash64("text"))
    placed = placed.withColumn("part", F.when(F.col("doc_id").isNull(), step(F.lit(first))).otherwise(F.lit(first) + search(0, len(cuts)) * most + inner))
    # The first row of each range that has rows, by id and hash: one row a range.
    heads = sorted((r["part"], r["least"]) for r in placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("least")).collect())
    to = [(least["doc_id"], least["h"], heads[i - 1][0], i == 0) for i, (_, least) in enumerate(heads)]
    head = spark.createDataFrame(to, "head long, head_h long, to int, wraps boolean")
    rows = placed.join(F.broadcast(head), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("lap"), F.lit(True).alias("own"))
    copy = F.struct(F.col("to").alias("part"), F.when(F.col("wraps"), 2).otherwise(1).alias("lap"), F.lit(False).alias("own"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    at = F.struct(F.col("copy.lap"), F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"), F.col("h"))
    return rows.select(F.col("copy.part").alias("part"), at.alias("at"), "doc_id", "text", F.col("copy.own").alias("own"))


def _let(value: Column, of) -> Column:
    """of(value) with value computed once, however often it is used."""
    return F.transform(F.array(value), of)[0]


def _print(found: Column, own: Column) -> Column:
    """struct<level, h> from the sorted array of struct<term, kept>: a long for each lexicon of the level, then of the next, 0 where it keeps no term."""
    level = F.greatest(F.lit(1), F.least(F.lit(LEVELS), F.floor(F.log2(F.size(found) / F.lit(KEPT))))).cast("long")

    def kept(terms: Column, j: int, least: Column) -> Column:
        return F.filter(terms, lambda t: t["kept"].bitwiseAND(F.lit(15 << 4 * j)) >= least)

    def name(terms: Column, j: int) -> Column:
        return F.when(F.size(terms) > 0, F.xxhash64(F.lit(j), F.array_join(F.transform(terms, lambda t: t["term"]), " "))).otherwise(F.lit(0).cast("long"))

    def two(j: int, at: Column) -> Column:
        unit = F.lit(1 << 4 * j)
        return _let(kept(found, j, at * unit), lambda own_terms: F.array(name(own_terms, j), name(kept(own_terms, j, (at + 1) * unit), j)))

    def of(at: Column) -> Column:
        def ordered(pairs: Column) -> Column:
            both = F.concat(F.transform(pairs, lambda p: p[0]), F.transform(pairs, lambda p: p[1]))
            whole = F.struct(F.lit(0).cast("long").alias("level"), F.array_repeat(own, 2 * LEXICONS).alias("h"))
            return F.when(F.exists(pairs, lambda p: p[0] != 0), F.struct(at.alias("level"), both.alias("h"))).otherwise(whole)

        return _let(F.array(*(two(j, at) for j in range(LEXICONS))), ordered)

    return _let(level, of)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons of common levels that keep a term of either; 0 if none does."""
    low, high = (lambda x: F.slice(x["h"], 1, LEXICONS)), (lambda x: F.slice(x["h"], LEXICONS + 1, LEXICONS))
    x = F.when(a["level"] == b["level"], a["h"]).when(a["level"] == b["level"] - 1, high(a)).when(a["level"] - 1 == b["level"], low(a)).otherwise(F.array().cast("array<bigint>"))
    y = F.when(a["level"] == b["level"], b["h"]).when(a["level"] == b["level"] - 1, low(b)).when(a["level"] - 1 == b["level"], high(b)).otherwise(F.array().cast("array<bigint>"))
    pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    some = F.size(F.filter(pairs, lambda z: (z["p"] != 0) | (z["q"] != 0)))
    same = F.size(F.filter(pairs, lambda z: (z["p"] == z["q"]) & (z["p"] != 0)))
    return F.when(some == 0, F.lit(0.0)).otherwise(same / some)


def fingerprints(docs: DataFrame, *, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tidy(F.col("text")).alias("text"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lex = materialize(lexicon(docs), "lexicon")
    if lex.count() <= BROADCAST_TERMS:
        lex = F.broadcast(lex)
    rows = with_next(docs, _ranges(docs, parts)).repartition(parts, "part")
    order = Window.partitionBy("part").orderBy("at", "text")
    n = F.length("text")
    rows = rows.withColumn("row", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.col("text")))
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next"), F.lit(1), cut)))
    rows = rows.withColumn("facts", F.struct("doc_id", "own", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("whole"), F.xxhash64("edited").alias("edited_whole")))
    # The texts are left behind before their terms become rows; a term of both is one row.  The facts ride with an empty term, so a text without terms stays.
    rows = rows.select("part", "row", "facts", terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
    none = F.lit(None).cast(rows.schema["facts"].dataType)
    entry = lambda x, where: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(where).alias("where"), none.alias("facts")))
    entries = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("where"), F.col("facts"))), entry(F.array_intersect("a", "b"), 3), entry(F.array_except("a", "b"), 1), entry(F.array_except("b", "a"), 2))
    exploded = rows.select("part", "row", F.explode(entries).alias("e")).select("part", "row", "e.term", "e.where", "e.facts")
    found = exploded.join(lex, "term", "left").where((F.col("term") == "") | F.col("kept").isNotNull())
    entry = F.when(F.col("kept").isNotNull(), F.struct("term", "kept", "where"))
    lists = found.groupBy("part", "row").agg(F.sort_array(F.collect_list(entry)).alias("found"), F.max("facts").alias("facts"))
    of = lambda kind: F.filter("found", lambda t: t["where"].bitwiseAND(F.lit(kind)) != 0)
    lists = lists.select("part", "row", "facts", of(1).alias("a"), of(2).alias("b"))
    whole = lists.select("part", "row", "facts", _print(F.col("a"), F.col("facts.whole")).alias("h"), _print(F.col("b"), F.col("facts.edited_whole")).alias("e"))
    order = Window.partitionBy("part").orderBy("row")
    whole = whole.withColumn("after", F.coalesce(F.lead("h").over(order), F.col("h")))
    text = lambda p: F.concat(F.lpad(p["level"].cast("string"), 2, "0"), F.array_join(F.transform(p["h"], lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""))
    return whole.where("facts.own").select(
        "facts.doc_id", "facts.n_chars", "facts.edited_sha256", text(F.col("h")).alias("fingerprint"), text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("h"), F.col("e")).alias("near_edited"), likeness(F.col("h"), F.col("after")).alias("near_next")
    )


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
