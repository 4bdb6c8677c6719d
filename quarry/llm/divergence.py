"""How a source's words differ from its language's and from each other source's.

Plain relational, inside the JVM: matches of a term pattern are exploded and
counted by (lang, source, term); terms in enough documents of their language
are its vocabulary; every group meets every term of its language's vocabulary,
so that terms it lacks count as 0; a self-join on (lang, term) compares each
two sources, and a comparison with the language's own counts gives each group
its most characteristic terms.

Counts are combined in each task before they are shuffled, so a frequent term
or a hot source is a row a task.  Groups meet the vocabulary by (lang, part of
the vocabulary), so a language that holds most rows is spread over all tasks.
All arithmetic is on integers (decimals where a product could pass 64 bits).

Defined results: null text, lang and source are the empty string; a group
without a kept term has ranks of every other source and no terms; repeated
rows count as the documents they are; ties in value are in byte order of the
item; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, tidy

#: What lies between terms, which are runs of ASCII letters and characters beyond ASCII.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a kept term is in, at least.
LEAST_DOCS = 10
#: Characteristic terms of a group.
TOP_TERMS = 10
UNIT = 1_000_000_000
LONGEST = 2**63 - 1
#: Rows of groups with terms that a part of a language's vocabulary makes, about.
PART_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences, and documents with the term, of every group."""
    text = tidy(F.col("text"))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # lower changes no more than A-Z of ASCII
    terms = F.array_remove(F.split(lowered, GAP), "")
    found = docs.select(tidy(F.col("lang")).alias("lang"), tidy(F.col("source")).alias("source"), terms.alias("found"))
    # Every occurrence, then every term once: what comes after the last occurrence counts documents.
    rows = found.select("lang", "source", F.size("found").alias("last"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("at", "term"))
    once = F.col("at") >= F.col("last")
    rows = rows.select("lang", "source", "term", F.when(once, 0).otherwise(1).cast("long").alias("n"), once.cast("long").alias("d"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exactly: in 64 bits where the product fits, else in decimals."""
    least, all_ = count + 2, total + 2 * terms
    wide = F.call_function("div", (F.lit(UNIT) * least.cast("decimal(19,0)")).cast("decimal(38,0)"), all_.cast("decimal(38,0)"))
    return F.lit(1) + F.when(least < LONGEST // UNIT, F.call_function("div", F.lit(UNIT).cast("long") * least, all_)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly; both are at most UNIT + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): see op12_source_divergence."""
    group, word = ["lang", "source"], ["lang", "term"]
    counts = materialize(term_counts(docs), "term-counts")
    vocabulary = materialize(counts.groupBy(*word).agg(F.sum("n").alias("of_lang"), F.sum("d").alias("docs")).where(F.col("docs") >= least_docs).select(*word, "of_lang"), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total"))
    kept = counts.select(*group, "term", "n").join(vocabulary.select(*word), word)
    totals = kept.groupBy(*group).agg(F.sum("n").alias("total"))
    groups = materialize(
        docs.select(tidy(F.col("lang")).alias("lang"), tidy(F.col("source")).alias("source")).distinct()
        .join(totals, group, "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]), "groups"
    )

    # Every group with every term of its language; the language's terms come in parts, each with a copy of its groups.
    parts = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.max("terms") / PART_ROWS)).cast("int").alias("parts"))
    copies = groups.join(parts, "lang").withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    part = F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")
    rated = vocabulary.join(parts, "lang").join(langs, "lang").select(*word, part.alias("nth"), smoothed(F.col("of_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    dense = rated.join(copies, ["lang", "nth"]).drop("nth").join(counts.select(*group, "term", "n"), [*group, "term"], "left").na.fill(0, ["n"])
    dense = materialize(
        dense.select(*group, "term", "n", smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "q"), "dense"
    )

    left = dense.select(*word, F.col("source").alias("a"), F.col("p"))
    right = dense.select(*word, F.col("source").alias("b"), F.col("p").alias("q"))
    sums = left.join(right, word).where(F.col("a") < F.col("b")).groupBy("lang", "a", "b").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    names = groups.select(*group)
    others = names.join(names.withColumnRenamed("source", "item"), "lang").where(F.col("source") != F.col("item"))
    pairs = others.join(both.select("lang", "x.*", "value"), ["lang", "source", "item"], "left").na.fill(0, ["value"])
    terms = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select(*group, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    out = [df.select(*group, F.lit(kind).alias("part"), "item", F.col("value").cast("long").alias("value"), place.alias("rank")) for kind, df in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1].where(F.col("rank") <= top_terms))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every (lang, source) of all documents: every other source of the language by how far their terms are apart, and its ten most characteristic terms."""
    return source_divergence(documents(spark, sf_dir))


#: The same rows in DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
t AS (SELECT i, lang, source, unnest(found) AS term FROM d),
per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS docs FROM t GROUP BY ALL),
voc AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM per GROUP BY ALL HAVING sum(docs) >= 10),
lang_size AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM voc GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM per JOIN voc USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, voc.term, coalesce(per.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(per.n, 0) + 2) // (coalesce(size.n, 0) + 2 * l.v) AS p,
         1 + 1000000000::HUGEINT * (voc.total + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN voc USING (lang) JOIN lang_size l USING (lang) LEFT JOIN size ON size.lang = g.lang AND size.source = g.source
       LEFT JOIN per ON per.lang = g.lang AND per.source = g.source AND per.term = voc.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(apart.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
