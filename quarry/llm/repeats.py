"""Repeated strings across a corpus by the common-prefix interval tree.

``maximal_repeats`` works on suffixes that lie sorted with the lengths of
their neighbours' common prefixes (an enhanced suffix array).  One scan with a
stack gives the tree of intervals, each a set of suffixes that share a prefix;
the strings to the left of an interval's members, reversed and sorted, give
its left extensions the same way, and where they diverge the group is a
maximal repeat with all its occurrences, not just neighbours.

A corpus does not fit one suffix array, so suffixes are sampled by content.
Of every LENGTH bytes the k-gram of least hash is the anchor; equal strings
have equal anchors, so only suffixes that start at equal anchors are compared,
with what stands around them.  Anchors that occur once are dropped before any
text is moved; equal surroundings are sorted once, with their number; groups
with more than ``GROUP`` different surroundings are not gathered in one task
but resolved by counting digests of their windows, exactly as well.

Defined results: a null or empty text has no bytes and keeps none; texts
shorter than LENGTH lose nothing; matches never cross documents; a null doc_id
and repeated rows are rows like any other (a repeated row repeats its text);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RangeHash, mix
from .common import documents, map_arrow, materialize, text_buffer, tidy

LENGTH = 200
KGRAM = 32
GROUP = 20_000
_SEED = np.uint64(0xA0761D6478BD642F)


def neighbours(strings: list[bytes]) -> list[int]:
    """Common prefix lengths of neighbours in a sorted list; entry i is for i and i + 1."""
    out = []
    for a, b in zip(strings, strings[1:]):
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            out.append(n)
            continue
        lo, hi = 0, n
        while lo < hi:  # most of a prefix is compared in C
            mid = (lo + hi + 1) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        out.append(lo)
    return out


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of two suffixes or more, children before parents."""
    stack: list[tuple[int, int]] = []
    for i, n in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > n:
            depth, left = stack.pop()
            yield depth, left, i
        if n >= 0 and (not stack or stack[-1][0] < n):
            stack.append((n, left))


def maximal_repeats(left: list[bytes], right: list[bytes], times: list[int], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, members) of every maximal repeat of at least ``least`` bytes.

    Member i stands at an anchor with right[i] from it on and left[i], reversed, before it, ``times`` times.
    """
    for i, n in enumerate(times):
        if n > 1 and len(left[i]) + len(right[i]) >= least:
            yield len(left[i]), len(right[i]), [i]
    order = sorted(range(len(right)), key=lambda i: (right[i], left[i]))
    most = max(map(len, left), default=0)
    for depth, first, last in intervals(neighbours([right[i] for i in order])):
        if depth + most < least:
            continue
        members = sorted(order[first : last + 1], key=lambda i: left[i])
        for back, a, b in intervals(neighbours([left[i] for i in members])):
            if back + depth >= least:
                group = members[a : b + 1]
                shared = {right[i][: depth + 1] for i in group}
                if len(shared) > 1 or len(next(iter(shared))) == depth:  # else a deeper interval has this group
                    yield back, depth, group


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each start of ``window`` values the place of the least, the leftmost on a tie."""
    n = len(hashes)
    rows = -(-n // window)
    packed = np.full(rows * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    packed[:n] = hashes & ~np.uint64(0xFF)
    grid = packed.reshape(rows, window) | np.arange(window, dtype=np.uint64)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    at = np.arange(n - window + 1)
    s, p = tail[at], head[at + window - 1]
    own = (s >> np.uint64(8)) <= (p >> np.uint64(8))
    base = np.where(own, at, at + window - 1) // window * window
    return base + (np.where(own, s, p) & np.uint64(0xFF)).astype(np.int64)


#: What a run of windows with one anchor is packed in: start, windows, bytes from the start to the anchor.
def _pack(start: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return (start << 16) | ((windows - 1) << 8) | lead


def _runs(length: int, kgram: int):
    """A function from a batch (doc, text) to its runs of windows that share an anchor."""
    grams, wide = RangeHash(), length - kgram + 1
    if wide > 256:
        raise ValueError("length - kgram + 1 is at most 256")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, start, end = text_buffer(batch.column(1))
        names = ["h", "sig", "doc", "run"]
        empty = pa.array([], pa.int64())
        if len(buf) < length:
            return pa.RecordBatch.from_arrays([empty] * 4, names)
        grams.load(buf)
        q = np.arange(len(buf) - kgram + 1)
        h = mix(grams.of(q, q + kgram) ^ _SEED)
        at = anchors(h, wide)
        row = np.repeat(np.arange(len(start)), end - start)[: len(at)]
        p = np.flatnonzero(np.arange(len(at)) + length <= end[row])
        if not len(p):
            return pa.RecordBatch.from_arrays([empty] * 4, names)
        a, r = at[p], row[p]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        windows = np.diff(np.append(first, len(p)))
        p0, a, r = p[first], a[first], r[first]
        sig = mix(grams.of(p0, p0 + windows - 1 + length) + (a - p0).astype(np.uint64) * _SEED)
        doc = batch.column(0).to_numpy(zero_copy_only=False)[r]
        return pa.RecordBatch.from_arrays([pa.array(h[a].view(np.int64)), pa.array(sig.view(np.int64)), pa.array(doc), pa.array(_pack(p0 - start[r], windows, a - p0))], names)

    return run


def _lazily(make):
    """make() called once in each worker's copy."""
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(make())
        return made[0](batch)

    return run


def _surroundings(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, text, doc, list of struct<h, sig, n, run, crowd>) to a row for each struct with its bytes."""
    h, sig, n, lead, crowd, seg = [], [], [], [], [], []
    for text, runs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
        raw = text.encode()
        for r in runs:
            p, windows = r["run"] >> 16, (r["run"] >> 8 & 255) + 1
            h.append(r["h"])
            sig.append(r["sig"])
            n.append(r["n"])
            lead.append(r["run"] & 255)
            crowd.append(r["crowd"])
            seg.append(raw[p : p + windows - 1 + LENGTH])
    columns = [pa.array(x, pa.int64()) for x in (h, sig, n, lead)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(crowd, pa.bool_()), pa.array(seg, pa.binary())], ["h", "sig", "n", "lead", "crowd", "seg"])


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h to (h, sig, spans): what maximal repeats cover of each surrounding, as start << 32 | end from its start."""
    rest: pd.DataFrame | None = None

    def groups(frame: pd.DataFrame) -> pd.DataFrame:
        h, sig, n, lead, seg = (frame[c].to_numpy() for c in ("h", "sig", "n", "lead", "seg"))
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])).tolist()
        oh, os, spans = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            if b - a == 1:  # a tree of one leaf
                if n[a] > 1:
                    oh.append(h[a])
                    os.append(sig[a])
                    spans.append([len(seg[a])])
                continue
            left = [seg[i][: lead[i]][::-1] for i in range(a, b)]
            right = [seg[i][lead[i] :] for i in range(a, b)]
            cover: list[set[tuple[int, int]]] = [set() for _ in range(b - a)]
            for back, on, members in maximal_repeats(left, right, [int(x) for x in n[a:b]], LENGTH):
                for m in members:
                    cover[m].add((int(lead[a + m]) - back, int(lead[a + m]) + on))
            for m, found in enumerate(cover):
                if found:
                    oh.append(h[a + m])
                    os.append(sig[a + m])
                    spans.append([s << 32 | e for s, e in _merged(found)])
        return pd.DataFrame({"h": np.array(oh, dtype=np.int64), "sig": np.array(os, dtype=np.int64), "spans": pd.Series(spans, dtype=object)})

    for frame in batches:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        h = frame["h"].to_numpy()
        if not len(h):
            continue
        last = np.searchsorted(h, h[-1])  # the last group may go on in the next batch
        rest = frame.iloc[last:]
        if last:
            yield groups(frame.iloc[:last])
    if rest is not None and len(rest):
        yield groups(rest)


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Surroundings of crowded anchors (h, sig, n, seg) to a row for each window, with its digest."""
    h, sig, n, at, w = [], [], [], [], []
    for hh, ss, nn, seg in zip(*(batch.column(i).to_pylist() for i in range(4))):
        for i in range(len(seg) - LENGTH + 1):
            h.append(hh)
            sig.append(ss)
            n.append(nn)
            at.append(i)
            w.append(hashlib.blake2b(seg[i : i + LENGTH], digest_size=16).digest())
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, sig, n, at)), pa.array(w, pa.binary())], ["h", "sig", "n", "at", "w"])


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, text, doc, list of struct<run, spans>) to the document's counts and the digest of what is left."""
    out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
    for text, parts in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
        raw = text.encode()
        spans = []
        for part in parts or ():
            p = part["run"] >> 16
            spans += [(p + (x >> 32), p + (x & 0xFFFFFFFF)) for x in part["spans"]]
        spans = _merged(spans)
        digest, at = hashlib.sha256(), 0
        for s, e in spans:
            digest.update(raw[at:s])
            at = e
        digest.update(raw[at:])
        for c, v in zip(out, (len(raw), sum(e - s for s, e in spans), len(spans), digest.hexdigest())):
            out[c].append(v)
    return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, *, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs: each byte goes that a string of LENGTH bytes covers which also starts elsewhere."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tidy(F.col("text")).alias("text"))
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    runs = map_arrow(docs.where(F.octet_length("text") >= LENGTH).select("doc", "text"), _lazily(lambda: _runs(LENGTH, KGRAM)), "h bigint, sig bigint, doc bigint, run bigint")
    common = runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    runs = materialize(runs.join(common, "h"), "runs")
    alike = runs.groupBy("h", "sig").agg(F.count("*").alias("n"), F.min(F.struct("doc", "run")).alias("first"))
    alike = materialize(alike, "surroundings")
    crowds = alike.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > group).select("h", F.lit(True).alias("crowd"))
    alike = alike.join(crowds, "h", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    wanted = alike.groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct("h", "sig", "n", F.col("first.run").alias("run"), "crowd")).alias("runs"))
    dealt = docs.repartition(parts, "doc")
    # A repeated row gives its surroundings twice: distinct texts of a doc hash are one.
    segs = map_arrow(dealt.join(wanted, "doc").select("doc_id", "text", "doc", "runs"), _surroundings, "h bigint, sig bigint, n bigint, lead bigint, crowd boolean, seg binary")
    segs = materialize(segs, "segments").dropDuplicates(["h", "sig"])
    calm = segs.where("not crowd").select("h", "sig", "n", "lead", "seg").repartition(parts, "h").sortWithinPartitions("h", "sig")
    covered = calm.mapInPandas(_covered, "h bigint, sig bigint, spans array<bigint>")
    windows = map_arrow(segs.where("crowd").select("h", "sig", "n", "seg"), _windows, "h bigint, sig bigint, n bigint, at bigint, w binary")
    often = windows.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").select("w")
    crowded = windows.join(often, "w").groupBy("h", "sig").agg(F.collect_list(F.shiftleft("at", 32) + F.col("at") + LENGTH).alias("spans"))
    found = materialize(covered.unionByName(crowded), "covered")
    marks = runs.join(found, ["h", "sig"]).groupBy("doc").agg(F.collect_list(F.struct("run", "spans")).alias("marks"))
    return map_arrow(dealt.join(marks, "doc", "left").select("doc_id", "text", "doc", "marks"), _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
