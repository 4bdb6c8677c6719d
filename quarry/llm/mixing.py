"""Mixing sources to target weights, by blocks.

Each source's words are laid end to end and cut into blocks of ``BLOCK``
words.  The mix is a row of output shards of ``SHARD`` slots, a slot for each
block.  Every shard draws its slots' sources by itself, seeded by its number,
with probabilities in proportion to the targets: a multinomial count of each
source.  A source's slots, in order of shard and slot, are its draws 0, 1, 2 ...;
each goes through the source's own pseudorandom permutation of its blocks, anew
for each pass over the source, and slots and blocks are joined by that index.
Free draws would miss the targets of small sources by their standard deviation
(a tenth for a source of 100 blocks); so the draws of a source beyond its
target, which lie in the last shards, go to the sources that got too few.

Only built-in functions are used.  A hot source is never in one task: offsets
come from sums per (source, bucket) and a window within the bucket, and the
join's keys are single blocks.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source, the last; a null doc_id is a row like any other, ordered
first; repeated rows are rows of their own; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, forget, materialize, tidy, word_count

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Words of a block, and output slots of a shard.
BLOCK, SHARD = 64, 4096
SEED = 20_240_229
ROUNDS = 14
CHUNK = 16_384
#: Documents in a bucket, about: the unit of one window's work; shards whose counts are summed at a time.
BUCKET_ROWS, SHARD_GROUP = 4_000, 1_024


def _swap(x: Column, r: Column, n: Column, key: Column) -> Column:
    """One round of the swap-or-not shuffle of 0 .. n-1."""
    other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
    top = F.greatest(x, other)
    return F.when(F.pmod(F.xxhash64(top, r, key), F.lit(2)) == 1, other).otherwise(x)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x's place in a pseudorandom permutation of 0 .. n-1 chosen by key."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), lambda at, r: _swap(at, r, n, key))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with weight and target.

    Sources in order of code points, null last, weigh 5, 2, 1, repeating; they
    share all sizes by weight, none above LIMIT times its own.  That is a
    water level: with sources in order of size per weight, the first k stop at
    their limit and the rest share what is left, for the least k that fits.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rated = sizes.withColumn("weight", F.array(*map(F.lit, WEIGHTS))[((F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("int")])
    rated = rated.withColumn("full_at", F.lit(float(LIMIT)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rated = rated.withColumn("level", (F.sum("source_size").over(everything) - LIMIT * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    rated = rated.withColumn("level", -F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", (-F.col("level")).alias("down")))).over(everything)["down"])
    return rated.select("source", "source_size", "weight", F.when(F.col("level").isNull() | (F.col("full_at") <= F.col("level")), F.lit(float(LIMIT)) * F.col("source_size")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, sources, drawn) for docs (doc_id, source, size, mark).

    placed: the rows with sid, source_size, target and first, the place of the row's first word in its source; sid and first name a row that has words.
    sources: source, sid, source_size, target, blocks, draws, low - the draws of sources before it.
    drawn: shard, slot, sid, block, pass - one row per slot.
    """
    sized = materialize(docs.select("doc_id", "source", "size", "mark"), "sizes")
    rows = sized.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(buckets)))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    # One row per source and bucket: a table smaller than documents by BUCKET_ROWS over the number of sources.
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    sources = sources.withColumn("draws", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), LIMIT * F.col("blocks"))).otherwise(F.lit(0)).cast("long"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    sources = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("low", F.sum("draws").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("draws"))
    sources = materialize(sources, "sources")
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.join(sources.select(F.col("source").alias("q"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("q")))
    placed = placed.select("doc_id", "source", "size", "mark", "sid", "source_size", "target", (F.col("base") + F.col("before")).alias("first"))
    return placed, sources, draws(sources)


def _numbers(rows: DataFrame, n: str, name: str, parts: int) -> DataFrame:
    """rows with name, each of 0 .. n - 1, of any n: by chunks, so that no row grows in one task; the number of tasks is fixed, as adaptive planning would leave one."""
    chunks = rows.where(F.col(n) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {CHUNK}"))))
    return chunks.repartition(parts, "sid", "chunk").withColumn(name, F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(n, (F.col("chunk") + 1) * CHUNK) - 1))).drop("chunk")


def draws(sources: DataFrame) -> DataFrame:
    """drawn of plan() for its sources."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = int(sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0])
    shards = -(-total // SHARD)
    # Every draw there will be is a ticket; a slot draws one of all, so a source in proportion to its draws.
    tickets = _numbers(sources.select("sid", "draws", "low"), "draws", "draw", parts).select((F.col("low") + F.col("draw")).alias("ticket"), "sid")
    slots = spark.range(0, shards, 1, max(1, min(shards, parts))).withColumnRenamed("id", "shard")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(SHARD), F.lit(total) - F.col("shard") * SHARD) - 1)))
    slots = slots.withColumn("ticket", F.pmod(F.xxhash64(F.lit(SEED), "shard", "slot"), F.lit(max(1, total)).cast("long")))
    in_shard = Window.partitionBy("shard", "sid").orderBy("slot")
    drawn = slots.join(tickets.hint("merge"), "ticket").select("shard", "slot", "sid", F.row_number().over(in_shard).cast("long").alias("nth"))
    drawn = materialize(drawn, "slots")
    # How many slots a source has in the shards before: sums of groups of shards, then of shards within a group.
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("n")).withColumn("group", F.expr(f"shard div {SHARD_GROUP}"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("sid", "group").agg(F.sum("n").alias("n")).withColumn("base", upto(Window.partitionBy("sid").orderBy("group"))).select("sid", "group", "base")
    counts = counts.withColumn("inner", upto(Window.partitionBy("sid", "group").orderBy("shard"))).join(groups, ["sid", "group"])
    counts = materialize(counts.select("shard", "sid", "n", (F.col("base") + F.col("inner")).alias("before")), "shard-counts")
    named = sources.select("sid", "draws", "blocks")
    drawn = drawn.join(counts.drop("n"), ["shard", "sid"]).join(named, "sid").withColumn("draw", F.col("before") + F.col("nth") - 1)
    # Slots over a source's target, numbered by shard and slot: one row a shard that has some, and those are the last ones.
    spare = drawn.where("draw >= draws").select("shard", "slot")
    held = spare.groupBy("shard").agg(F.count("*").alias("n")).withColumn("base", upto(Window.orderBy("shard"))).select("shard", "base")
    spare = spare.withColumn("at", F.row_number().over(Window.partitionBy("shard").orderBy("slot"))).join(held, "shard").select("shard", "slot", (F.col("base") + F.col("at") - 1).alias("place"))
    short = named.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).withColumn("n", F.greatest(F.col("draws") - F.col("got"), F.lit(0)))
    short = _numbers(short.withColumn("base", upto(Window.orderBy("sid"))), "n", "more", parts)
    short = short.select((F.col("base") + F.col("more")).alias("place"), "sid", "blocks", (F.col("got") + F.col("more")).alias("draw"))
    drawn = drawn.where("draw < draws").select("shard", "slot", "sid", "blocks", "draw").unionByName(spare.join(short, "place").drop("place"))
    drawn = drawn.withColumn("pass", F.expr("draw div blocks"))
    return drawn.select("shard", "slot", "sid", permuted(F.col("draw") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(SEED), "sid", "pass")).alias("block"), "pass")


def pieces(placed: DataFrame) -> DataFrame:
    """(sid, block, first, start, length): each document's share of each block; sid and first name it, start counts its words."""
    last = F.col("first") + F.col("size") - 1
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.floor(last / BLOCK))))
    begin = F.greatest(F.col("first"), F.col("block") * BLOCK)
    return cut.select("sid", "block", "first", (begin - F.col("first")).alias("start"), (F.least(last + 1, (F.col("block") + 1) * BLOCK) - begin).alias("length"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and mark (tells rows of one doc_id apart) of docs."""
    text = tidy(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(text, tidy(F.col("source"))).alias("mark"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the first and last shard that has words of it (null if none), of every row of docs."""
    placed, _, drawn = plan(sized(docs))
    times = drawn.groupBy("sid", "block").agg(F.count("*").alias("times"), F.min("shard").alias("s0"), F.max("shard").alias("s1"))
    part = pieces(placed).select("sid", "block", "first", "length")
    # Planned from the size of sources, draws look small enough to broadcast; they are not.
    got = part.join(times.hint("merge"), ["sid", "block"]).groupBy("sid", "first").agg(F.sum(F.col("length") * F.col("times")).alias("got"), F.min("s0").alias("first_shard"), F.max("s1").alias("last_shard"))
    # Rows without words share their place with a neighbour's: they take nothing.
    got = got.select(F.col("sid").alias("g"), F.col("first").alias("f"), "got", "first_shard", "last_shard")
    out = placed.join(got, (F.col("sid") == F.col("g")) & (F.col("first") == F.col("f")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the words that the mix takes, as rows with the columns of docs.

    Blocks of one document that a pass takes side by side are one row again, so
    a document whose blocks are all taken comes whole, once for each pass; the
    text is the taken words with single spaces, n_chars is its length, and
    other columns are the document's.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text", "source")}
    basic = flat.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), F.col(at["source"]).alias("source"))
    placed, _, drawn = plan(sized(basic))
    # Written one after the other: as one plan their scans and broadcasts all lie in the driver at once, and placed is made twice.
    placed, drawn = materialize(placed.select("doc_id", "size", "mark", "sid", "first"), "placed"), materialize(drawn, "drawn")
    part = pieces(placed).select("sid", "block", "first", "start", "length").join(drawn.select("sid", "block", "pass").hint("merge"), ["sid", "block"])
    # Neighbouring pieces of a document in a pass: their start less the words before them in the pass is alike.
    inside = Window.partitionBy("sid", "first", "pass").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("group", F.col("start") - F.coalesce(F.sum("length").over(inside), F.lit(0)))
    spans = part.groupBy("sid", "first", "pass", "group").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    spans = spans.groupBy("sid", "first").agg(F.sort_array(F.collect_list(F.struct("pass", "start", "length"))).alias("spans"))
    keys = placed.where("size > 0").select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "sid", "first")
    wanted = keys.join(spans, ["sid", "first"])
    # Rows alike in doc_id, text and source are matched one to one by their number.
    alike = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(*c))
    wanted = materialize(wanted.select("d", "m", "spans", alike("d", "m").alias("nth")), "spans")
    forget(placed, drawn)
    marked = flat.withColumn("d", F.col(at["doc_id"]).cast("long")).withColumn("m", F.xxhash64(tidy(F.col(at["text"])), tidy(F.col(at["source"]))))
    marked = marked.withColumn("nth", alike("d", "m"))
    right = wanted.select(F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("nth").alias("n2"), "spans")
    taken = marked.join(right, F.col("d").eqNullSafe(F.col("d2")) & (F.col("m") == F.col("m2")) & (F.col("nth") == F.col("n2")))
    words = F.regexp_extract_all(F.col(at["text"]), F.lit(WORD), F.lit(0))
    texts = F.transform("spans", lambda s: F.array_join(F.slice(F.col("words"), (s["start"] + 1).cast("int"), s["length"].cast("int")), " "))
    out = taken.withColumn("words", words).withColumn(at["text"], F.explode(texts))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")
