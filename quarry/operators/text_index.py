"""A stored BM25 index: segments of postings in blocks, best block first.

*Segments.*  A sync writes what is new since the last one as a small segment
and marks what went or changed as dead in the segments that have it; numbers of
documents, lengths and document frequencies are sums over segments less the
dead.  ``FAN`` segments of a size class are merged into one, so a document is
written anew a logarithmic number of times.  A snapshot log makes each sync
appear at once and tells two writers apart.

*Blocks.*  A term's postings lie in descending order of what they can add to a
score, ``BLOCK`` to a row, which has the block's greatest share.  A search reads
the first blocks, learns from them what the k-th best score is at least, and
then only those blocks that could hold a better document; a frequent word that
cannot decide anything is looked up for the candidates alone, in the forward
rows (terms of a document), and its postings are not read at all.

*Freshness.*  A handle is current if the files behind the rows have the names,
sizes and times that it was made of; texts are hashed only if they do not.

Defined results: rows with a null id are left out, a null text has no words;
ids are unique; scores and order equal ``retrieval.sparse_top_k``'s.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..sources.snapshots import Conflict, Snapshots
from . import retrieval

#: The layout of what is stored.
FORMAT = 2
#: Postings in a block; segments of a size class that become one; documents of the smallest class.
BLOCK, FAN, SMALLEST = 512, 4, 1_000
#: Postings that a folder of terms is for, and documents that a folder of forward rows is for.
FOLDER_POSTINGS, FOLDER_DOCS = 2_000_000, 50_000
#: Candidates that are looked up by a list of ids; words whose statistics a handle keeps; words of a query that are weighed by an expression.
LISTED, WORDS_KEPT, INLINE = 2_000, 10_000, 32
#: Bounds are compared with this much room for rounding.
ROOM = 1e-9


def freshness(df: DataFrame) -> str | None:
    """A token of the folders behind df (names, sizes and times of their files) and of what df does with them; none where it reads no files."""
    files = df.inputFiles()
    if not files:
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    found = []
    for folder in sorted({f.rsplit("/", 1)[0] for f in files}):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        found += sorted((folder, s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in at.getFileSystem(conf).listStatus(at) if s.isFile())
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    return hashlib.sha256(repr((plan, found)).encode()).hexdigest()


def _bucket(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., tokens) as (.., len, terms, tfs): each document's distinct words, and how often it has them."""
    for batch in batches:
        tokens = batch.column("tokens")
        ends = tokens.offsets.to_numpy()
        codes = tokens.flatten().dictionary_encode()
        words, flat = codes.dictionary, codes.indices.to_numpy()
        sizes = np.diff(ends)
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * max(1, len(words)) + flat, return_counts=True)
        rows = pairs // max(1, len(words))
        cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(sizes))))).astype(np.int32))
        terms = pa.ListArray.from_arrays(cuts, words.take(pa.array(pairs % max(1, len(words)))))
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "tokens"]
        names = [n for n in batch.schema.names if n != "tokens"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes.astype(np.int32)), terms, pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], names=[*names, "len", "terms", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted postings as blocks of one term; lead marks a term's first block in this task."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term")
        codes = terms.dictionary_encode()
        flat = codes.indices.to_numpy()
        edges = [0, *(np.flatnonzero(flat[1:] != flat[:-1]) + 1).tolist(), len(flat)]
        starts, lead = [], []
        for a, b in zip(edges, edges[1:]):
            cut = list(range(a, b, size))
            starts += cut
            word = terms[a].as_py()
            lead += [word != last] + [False] * (len(cut) - 1)
            last = word
        cuts = pa.array(np.array([*starts, len(flat)], dtype=np.int32))
        at = pa.array(np.array(starts, dtype=np.int32))
        lists = [pa.ListArray.from_arrays(cuts, batch.column(c)) for c in ("id", "kind", "tf", "len")]
        yield pa.RecordBatch.from_arrays([batch.column("bucket").take(at), terms.take(at), batch.column("share").take(at), pa.array(lead), pa.array(np.diff(cuts.to_numpy()).astype(np.int32)), *lists], names=["bucket", "term", "top", "lead", "n", "ids", "kinds", "tfs", "lens"])


@dataclass
class Report:
    """Of each word of a query: documents that have it, blocks it has, blocks that were read, and whether its postings could decide."""

    n: int = 0
    candidates: int = 0
    words: dict[str, dict] = field(default_factory=dict)
    reads: list[DataFrame] = field(default_factory=list, repr=False)


@dataclass
class TextIndex:
    """A handle on one snapshot of the index below a path."""

    spark: SparkSession
    path: str
    version: int | None = None

    def __post_init__(self) -> None:
        self.log = Snapshots(self.spark, self.path)
        self.version = self.log.latest() if self.version is None else self.version
        self.manifest = self.log.manifest(self.version) if self.version is not None else {}
        if self.manifest.get("format") != FORMAT:  # another layout is built anew
            self.manifest = {"format": FORMAT, "segments": [], "token": None}
        self._known: dict[str, list] = {}

    # --- writing -----------------------------------------------------------------

    def fresh(self, df: DataFrame) -> bool:
        """Whether the index is of df's files as they are now."""
        token = freshness(df)
        return token is not None and token == self.manifest["token"]

    def sync(self, df: DataFrame, *, id: str = "chunk_id", text: str = "chunk_text", kind: str | None = None) -> TextIndex:
        """The handle of a snapshot that has df's rows as they are now: this one if it has, else a new one."""
        token = freshness(df)
        if token is not None and token == self.manifest["token"]:
            return self
        rows = self._named(df, id, text, kind)
        if not self.manifest["segments"]:
            return self._committed(rows, None, token)
        now = rows.select("id", F.xxhash64("kind", "text").alias("_now"))
        diff = self._docs(["id", "digest", "segment"]).join(now, "id", "full_outer").where(~F.coalesce(F.col("digest") == F.col("_now"), F.lit(False)))
        names = self.log.put(diff.select("id", "segment", F.col("_now").isNotNull().alias("here")), "diff")
        diff = self.spark.read.parquet(f"{self.log.path}/{names}")
        if diff.isEmpty():
            self.log._fs().delete(self.log._at(names), True)
            return self if token is None else TextIndex(self.spark, self.path, self.log.commit(self.manifest | {"token": token}, self.version))
        out = self._committed(rows.join(diff.where("here").select("id"), "id", "left_semi"), diff.where("segment IS NOT NULL").select("id", "segment"), token)
        self.log._fs().delete(self.log._at(names), True)
        return out

    def _replaced(self, df: DataFrame, id: str, text: str) -> TextIndex:
        made = self._segment(self._forward(self._named(df, id, text, None)))
        return TextIndex(self.spark, self.path, self.log.commit({"format": FORMAT, "segments": [made] if made["n"] else [], "token": freshness(df)}, self.version))

    def update(self, changes: DataFrame | None = None, gone: DataFrame | None = None, *, id: str = "chunk_id", text: str = "chunk_text", kind: str | None = None) -> TextIndex:
        """The handle of a snapshot with these rows new or changed and these ids gone, where the caller knows them."""
        rows = None if changes is None else self._named(changes, id, text, kind)
        ids = [df.select("id") for df in (rows, None if gone is None else gone.select(F.col(id).alias("id"))) if df is not None]
        dead = None
        if ids and self.manifest["segments"]:
            touched = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
            dead = self._docs(["id", "segment"]).join(touched.distinct(), "id", "left_semi")
        return self._committed(rows, dead, None)

    def _named(self, df: DataFrame, id: str, text: str, kind: str | None) -> DataFrame:
        rows = df.select(F.col(id).alias("id"), (F.col(kind).cast("string") if kind else F.lit(None).cast("string")).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return rows.where(F.col("id").isNotNull())

    def _committed(self, rows: DataFrame | None, dead: DataFrame | None, token: str | None) -> TextIndex:
        segments = [dict(s) for s in self.manifest["segments"]]
        if dead is not None:
            self._bury(segments, dead)
        if rows is not None:
            made = self._segment(self._forward(rows))
            segments += [made] if made["n"] else []
        segments = self._merged(segments)
        return TextIndex(self.spark, self.path, self.log.commit({"format": FORMAT, "segments": segments, "token": token}, self.version))

    def _forward(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("id", "kind", F.xxhash64("kind", "text").alias("digest"), T.search_words(F.col("text")).alias("tokens"))
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(_counted, f"id {kind}, kind string, digest long, len int, terms array<string>, tfs array<int>")

    def _segment(self, forward: DataFrame) -> dict:
        """Writes forward rows as a segment: they themselves, blocks of postings, and a row for each term."""
        aside = self.log.put(forward, "aside")
        rows = self.spark.read.parquet(f"{self.log.path}/{aside}")
        n, length, postings = rows.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        average = length / n if n else 0.0
        doc_folders, term_folders = max(1, -(-n // FOLDER_DOCS)), max(1, -(-postings // FOLDER_POSTINGS))
        docs = rows.withColumn("bucket", _bucket("id", doc_folders)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
        share = F.col("tf") / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("len") / F.lit(average or 1.0)))
        flat = rows.select("id", "kind", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"), "id", "kind", "len")
        flat = flat.select(_bucket("term", term_folders).alias("bucket"), "term", share.alias("share"), "id", "kind", "tf", "len")
        order = [F.col("bucket"), F.col("term"), F.col("share").desc(), F.col("id")]
        kind = rows.schema["id"].dataType.simpleString()
        size = BLOCK
        blocks = flat.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _blocks(b, size), f"bucket int, term string, top double, lead boolean, n int, ids array<{kind}>, kinds array<string>, tfs array<int>, lens array<int>")
        blocks = self.log.put(blocks, "blocks", ("bucket",), {"parquet.block.size": str(8 << 20)})
        heads = self._read(blocks, blocks_schema(kind)).groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.count("*").alias("blocks"), F.max("top").alias("top"))
        out = {"docs": self.log.put(docs, "docs", ("bucket",)), "blocks": blocks, "terms": self.log.put(heads.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "terms", ("bucket",))}
        self.log._fs().delete(self.log._at(aside), True)
        return out | {"n": n, "len": length, "average": average, "doc_folders": doc_folders, "term_folders": term_folders, "id": kind, "dead": [], "minus": [], "n_dead": 0, "len_dead": 0}

    def _bury(self, segments: list[dict], dead: DataFrame) -> None:
        """Marks (id, segment) as dead, and what their terms' frequencies lose."""
        put = self.log.put(dead.dropDuplicates(["id", "segment"]), "dead", ("segment",))
        for name in self.log._listed(put):
            if not name.startswith("segment="):
                continue
            s = segments[int(name.split("=")[1])]
            ids = self.spark.read.schema(f"id {s['id']}").parquet(f"{self.log.path}/{put}/{name}")
            lost = self._read(s["docs"], docs_schema(s["id"])).join(ids, "id", "left_semi")
            n, length = lost.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            minus = lost.select(F.explode("terms").alias("term")).groupBy(_bucket("term", s["term_folders"]).alias("bucket"), "term").agg(F.count("*").alias("df"))
            s |= {"dead": [*s["dead"], f"{put}/{name}"], "minus": [*s["minus"], self.log.put(minus, "minus", ("bucket",))], "n_dead": s["n_dead"] + n, "len_dead": s["len_dead"] + length}

    def _merged(self, segments: list[dict]) -> list[dict]:
        """Segments after merging: FAN of a size class into one, one with as many dead as living ones alone."""
        size = lambda s: max(0, math.floor(math.log(max(1, s["n"] - s["n_dead"]) / SMALLEST, FAN)) + 1) if s["n"] - s["n_dead"] >= SMALLEST else 0
        while True:
            classes: dict[int, list[dict]] = {}
            for s in segments:
                classes.setdefault(size(s), []).append(s)
            worn = [[s] for s in segments if s["n_dead"] and 2 * s["n_dead"] >= s["n"]]
            due = next((c for _, c in sorted(classes.items()) if len(c) >= FAN), None) or (worn[0] if worn else None)
            if not due:
                return segments
            made = self._segment(self._living(due, ["id", "kind", "digest", "len", "terms", "tfs"]))
            segments = [s for s in segments if not any(s is d for d in due)] + ([made] if made["n"] else [])

    def compact(self) -> TextIndex:
        """The handle of a snapshot with all segments in one: this one where there is one without dead rows."""
        if len(self.manifest["segments"]) == 1 and not self.manifest["segments"][0]["n_dead"]:
            return self
        made = self._segment(self._living(self.manifest["segments"], ["id", "kind", "digest", "len", "terms", "tfs"]))
        return TextIndex(self.spark, self.path, self.log.commit({"format": FORMAT, "segments": [made] if made["n"] else [], "token": self.manifest["token"]}, self.version))

    # --- reading -----------------------------------------------------------------

    def _read(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.log.path}/{folder}")

    def _dead(self, s: dict) -> DataFrame:
        return self.spark.read.schema(f"id {s['id']}").parquet(*(f"{self.log.path}/{d}" for d in s["dead"]))

    def _living(self, segments: list[dict], columns: list[str]) -> DataFrame:
        out: DataFrame | None = None
        for s in segments:
            rows = self._read(s["docs"], docs_schema(s["id"]))
            rows = rows.join(self._dead(s), "id", "left_anti") if s["dead"] else rows
            rows = rows.select(*columns)
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("the index has no segment")
        return out

    def _docs(self, columns: list[str]) -> DataFrame:
        """Living documents, with the number of their segment."""
        out: DataFrame | None = None
        for i, s in enumerate(self.manifest["segments"]):
            rows = self._living([s], [c for c in columns if c != "segment"]).withColumn("segment", F.lit(i))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "id long, digest long, segment int").select(*columns)

    def size(self) -> tuple[int, float]:
        """(documents, mean length) now."""
        n = sum(s["n"] - s["n_dead"] for s in self.manifest["segments"])
        return n, sum(s["len"] - s["len_dead"] for s in self.manifest["segments"]) / n if n else 0.0

    def _statistics(self, words: list[str]) -> list[dict[str, list]]:
        """For each segment, of each word [documents, blocks, greatest share]: a row for each word and segment comes to the driver, once for a handle."""
        asked = [w for w in words if w not in self._known]
        if len(self._known) + len(asked) > WORDS_KEPT:
            self._known.clear()
            asked = words
        for w, held in zip(asked, zip(*[[s.get(w) for w in asked] for s in self._looked_up(asked)])) if asked else ():
            self._known[w] = list(held)
        return [{w: self._known[w][i] for w in words if self._known[w][i] is not None} for i in range(len(self.manifest["segments"]))]

    def _looked_up(self, words: list[str]) -> list[dict[str, list]]:
        found: DataFrame | None = None
        for i, s in enumerate(self.manifest["segments"]):
            own = F.col("bucket").isin(self._folders(words, s["term_folders"])) & F.col("term").isin(words)
            parts = [self._read(s["terms"], "term string, df long, blocks long, top double, bucket int").where(own).select("term", "df", "blocks", "top")]
            parts += [self._read(m, "term string, df long, bucket int").where(own).select("term", (-F.col("df")).alias("df"), F.lit(0).cast("long").alias("blocks"), F.lit(0.0).alias("top")) for m in s["minus"]]
            for p in parts:
                p = p.withColumn("segment", F.lit(i))
                found = p if found is None else found.unionByName(p)
        out: list[dict[str, list]] = [{} for _ in self.manifest["segments"]]
        for term, df, blocks, top, i in found.collect() if found is not None else ():
            have = out[i].setdefault(term, [0, 0, 0.0])
            out[i][term] = [have[0] + df, have[1] + blocks, max(have[2], top)]
        return out

    def _folders(self, words: list[str], n: int) -> list[int]:
        return self._buckets(words, "string", n)

    def _buckets(self, values: list, kind: str, n: int) -> list[int]:
        """Folders of these values, by Spark's own hash."""
        return [0] if n == 1 else sorted(set(self.spark.sql("SELECT 1").select(F.transform(F.lit(values).cast(f"array<{kind}>"), lambda v: _bucket(v, n))).first()[0]))

    def _postings(self, cuts: list[dict[str, float]], lead: bool = False) -> list[tuple[dict, DataFrame]]:
        """Blocks of each segment whose greatest share reaches the word's cut, before they are taken apart."""
        out = []
        for s, cut in zip(self.manifest["segments"], cuts):
            if not cut:
                continue
            wanted = F.lit(False)
            for word, least in cut.items():
                wanted = wanted | ((F.col("term") == word) & (F.col("top") >= least))
            rows = self._read(s["blocks"], blocks_schema(s["id"])).where(F.col("bucket").isin(self._folders(sorted(cut), s["term_folders"])) & F.col("term").isin(sorted(cut)) & wanted)
            out.append((s, rows.where("lead") if lead else rows))
        return out

    def _summed(self, blocks: list[tuple[dict, DataFrame]], weights: dict[str, float], average: float, kind: str | None) -> DataFrame:
        """(id, part): what the blocks' words add to each living document's score, as a positive number."""
        if not blocks:
            return self.spark.createDataFrame([], f"id {self.manifest['segments'][0]['id']}, part double")
        out: DataFrame | None = None
        for s, rows in blocks:
            flat = rows.select("term", F.explode(F.arrays_zip("ids", "kinds", "tfs", "lens")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.kinds").alias("kind"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
            flat = flat.where(F.col("kind") == kind) if kind is not None else flat
            flat = flat.join(self._dead(s), "id", "left_anti") if s["dead"] else flat
            flat = flat.select("term", "id", "tf", "len")
            out = flat if out is None else out.unionByName(flat)
        norm = retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("len") / F.lit(average or 1.0))
        if len(weights) <= INLINE:
            weight = F.coalesce(*(F.when(F.col("term") == w, F.lit(x)) for w, x in weights.items()))
            out = out.withColumn("weight", weight)
        else:
            table = self.spark.createDataFrame(list(weights.items()), "term string, weight double")
            out = out.join(F.broadcast(table), "term")  # a row for each word of the query
        part = F.col("weight") * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + norm)
        return out.groupBy("id").agg(F.sum(part).alias("part"))

    def _in_full(self, ids: list | DataFrame, weights: dict[str, float], average: float) -> DataFrame:
        """(id, score) of these documents from their forward rows, as a positive number."""
        out: DataFrame | None = None
        for s in self.manifest["segments"]:
            rows = self._read(s["docs"], docs_schema(s["id"]))
            if isinstance(ids, list):
                rows = rows.where(F.col("bucket").isin(self._buckets(ids, s["id"], s["doc_folders"])) & F.col("id").isin(ids))
            else:
                rows = rows.join(ids.select("id"), "id", "left_semi")
            rows = rows.join(self._dead(s), "id", "left_anti") if s["dead"] else rows
            rows = rows.select("id", "len", F.map_from_arrays("terms", "tfs").alias("has"))
            out = rows if out is None else out.unionByName(rows)
        norm = retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("len") / F.lit(average or 1.0))
        score = F.lit(0.0)
        for word, weight in sorted(weights.items()):
            tf = F.coalesce(F.col("has")[word], F.lit(0))
            score = score + weight * tf * (retrieval.K1 + 1) / (tf + norm)
        return out.select("id", score.alias("score"))

    def search(self, query: str, k: int = retrieval.POOL, *, kind: str | None = None, id: str = "chunk_id") -> DataFrame:
        """(id, score, rank), as retrieval.sparse_top_k gives; kind narrows what may be returned."""
        return self.search_with_report(query, k, kind=kind, id=id)[0]

    def search_with_report(self, query: str, k: int = retrieval.POOL, *, kind: str | None = None, id: str = "chunk_id") -> tuple[DataFrame, Report]:
        """The same, and what was read for it."""
        k = max(1, min(int(k), retrieval.HIT_ROWS))
        words = retrieval.query_words(query)
        distinct, segments = sorted(set(words)), self.manifest["segments"]
        n, average = self.size()
        report = Report(n)
        schema = StructType.fromDDL(f"`{id}` {segments[0]['id'] if segments else 'bigint'}, score double, rank int")
        if not words or not n:
            return self.spark.createDataFrame([], schema), report
        found = self._statistics(distinct)
        often = {w: sum(s.get(w, [0])[0] for s in found) for w in distinct}
        idf = {w: math.log((n - often[w] + 0.5) / (often[w] + 0.5)) for w in distinct}
        weights = {w: words.count(w) * (idf[w] if idf[w] > 0 else retrieval.LEAST_IDF) for w in distinct if often[w] > 0}
        # A segment's shares are of its own mean length; with a longer mean now they grow by that factor at most.
        grown = [max(1.0, average / s["average"]) if s["average"] else 1.0 for s in segments]
        most = {w: max((weights[w] * (retrieval.K1 + 1) * min(1.0, s[w][2] * g) for s, g in zip(found, grown) if w in s), default=0.0) for w in weights}
        report.words = {w: {"documents": often[w], "blocks": sum(s.get(w, [0, 0])[1] for s in found), "read": 0, "decides": False} for w in distinct}
        if not weights:
            return self.spark.createDataFrame([], schema), report

        first = self._postings([{w: s[w][2] for w in s if w in weights} for s in found], lead=True)
        # What a document has in the first blocks is its score or less.
        known = [r[0] for r in self._summed(first, weights, average, kind).select("part").orderBy(F.desc("part")).limit(k).collect()]
        least = known[k - 1] * (1 - ROOM) if len(known) >= k else 0.0

        cut, spare = self._cuts(most, least)
        cuts = [{w: cut[w] / (weights[w] * (retrieval.K1 + 1) * g) - ROOM for w in s if w in weights and cut[w] <= most[w] * (1 + ROOM)} for s, g in zip(found, grown)]
        blocks = self._postings(cuts)
        for w in weights:
            report.words[w]["decides"] = any(w in c for c in cuts)
        report.reads = [rows.select("term") for _, rows in blocks]
        scored = self._summed(blocks, weights, average, kind).where(F.col("part") + spare >= least)
        best = scored.orderBy(F.desc("part"), "id").limit(max(LISTED, k) + 1).collect()
        report.candidates = len(best)
        if len(best) <= max(LISTED, k) or best[k - 1][1] * (1 - ROOM) > best[-1][1] * (1 + ROOM) + spare:
            full = self._in_full([r[0] for r in best], weights, average) if best else None
        else:  # more that may be among the first k than a list of ids is good for
            full = self._in_full(scored, weights, average)
        top = full.orderBy(F.desc("score"), "id").limit(k).collect() if full is not None else []
        columns = [[r[0] for r in top], [-float(r[1]) for r in top], list(range(1, len(top) + 1))]
        return self.spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema), report

    def _cuts(self, most: dict[str, float], least: float) -> tuple[dict[str, float], float]:
        """(what a block of each word must be able to add to be read, what unread blocks may add to a candidate at most).

        A document that scores ``least`` is met in a block of the strongest word
        it has if of each word all blocks are read that reach least less all
        weaker words.  What it has of words in unread blocks is then unknown; where
        that is too much to leave open, blocks are read down to least less all
        other words, below which no document of that score has anything.
        """
        order = sorted(most, key=lambda w: (-most[w], w))
        weaker, met = 0.0, {}
        for w in reversed(order):
            met[w] = max(0.0, least - weaker)
            weaker += most[w]
        cut, spare = {}, 0.0
        for w in sorted(order, key=lambda w: min(most[w], met[w])):
            left = min(most[w], met[w])
            if spare + left <= least / 4:
                cut[w], spare = met[w], spare + left
            else:
                cut[w] = max(0.0, least - (weaker - most[w]))
        return cut, spare

    def blocks_read(self, report: Report) -> Report:
        """report with the number of blocks that its search read of each deciding word."""
        for rows in report.reads:
            for word, read in rows.groupBy("term").count().collect():
                report.words[word]["read"] += read
        return report


def docs_schema(id: str) -> str:
    return f"id {id}, kind string, digest long, len int, terms array<string>, tfs array<int>, bucket int"


def blocks_schema(id: str) -> str:
    return f"term string, top double, lead boolean, n int, ids array<{id}>, kinds array<string>, tfs array<int>, lens array<int>, bucket int"


#: The last handle of each path that this process opened: it keeps what it looked up while its snapshot is the newest.
_OPEN: dict[tuple[str, str], TextIndex] = {}


def open_index(df: DataFrame, path: str, *, id: str = "chunk_id", text: str = "chunk_text", kind: str | None = None) -> TextIndex:
    """The index below path, brought up to df's rows."""
    at = (df.sparkSession.sparkContext.applicationId, path)
    for attempt in range(3):
        index = _OPEN.get(at)
        if index is None or index.version != index.log.latest():
            index = TextIndex(df.sparkSession, path)
        try:
            _OPEN[at] = index = index.sync(df, id=id, text=text, kind=kind)
            return index
        except Conflict:  # another writer was first: what it left is brought up to date
            if attempt == 2:
                raise
    raise AssertionError


def newest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest snapshot; none without an index."""
    return Snapshots(spark, path).latest()


def build_index(df: DataFrame, path: str, *, id: str = "chunk_id", text: str = "chunk_text") -> int:
    """Writes an index of df, in place of what the one below path held, and returns the snapshot's number."""
    index = TextIndex(df.sparkSession, path)
    return index._replaced(df, id, text).version


def sync_index(df: DataFrame, path: str, *, id: str = "chunk_id", text: str = "chunk_text") -> int:
    """The number of the snapshot that has df's rows as they are now: the newest if nothing changed since, else a new one."""
    return open_index(df, path, id=id, text=text).version


def search_index(spark: SparkSession, path: str, query: str, k: int = retrieval.POOL, *, id: str = "chunk_id", version: int | None = None) -> DataFrame:
    """TextIndex.search in a snapshot, by default the newest."""
    return TextIndex(spark, path, version).search(query, k, id=id)
