"""Near-duplicates by DartMinHash signatures and banded joining.

A text is the weighted set of its five-word shingles, weighted by how often
each occurs.  DartMinHash throws darts, that is hashed points (weight, rank),
into the region under each element's weight, in strips of unit area that all
texts share; of the darts that land on a coordinate the one of lowest rank
stays.  Two texts agree on a coordinate with the probability of their weighted
Jaccard similarity, and a text costs its number of shingles plus about
``DARTS`` darts, not shingles times coordinates.

Bands of coordinates are joined on equal keys.  First a few rounds give each
text one partner, the one of its buckets' leads that it meets most often; texts
found similar become one class, and later rounds and buckets know a class by
one of its texts.  So a round verifies no more pairs than there are texts.
What buckets
of several classes are left is finished exactly.  Members are dealt into
blocks; a task compares the texts of two blocks and returns no more links than
join their classes; blocks of the largest class meet those of the others only.
So each pair that shares a bucket is compared or already in one class, and none
is lost but those that share no bucket.

Blocks cost the square of a bucket, so two kinds of crowd are first made small,
without any loss.  A class of over ``CROWD`` texts lies in many buckets that are
nearly alike: it meets the others of all of them at once.  A bucket with over
``CROWD`` texts outside its largest class (a template that much text shares) is
parted by prefixes.  Elements have one order for all, rarest first.  Texts of
a and b elements, a <= b, that are similar share at least ``c (a + b)`` of
them, so the first of them in that order lies among the first
``a - c (a + b) + 1`` of the one and ``b - c (a + b) + 1`` of the other.  The
smaller text is filed under its size and its first ninth, which does for every
larger one; the larger looks each size up with just the prefix which that size
allows.  So what a template's texts share is looked up by none of them whose
own parts keep it under the threshold, and such a family costs its texts, not
their pairs.  Every link is verified on the whole texts.  Classes are connected
components.

Defined results: equal texts are one class, the empty text (and null) among
them; a text of fewer than five words is one shingle of all its words; a text
of blanks only equals only itself; a null doc_id is a row like any other and
never names a class that has an id; repeated rows keep their rows; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RangeHash, mix, powers
from .common import documents, forget, map_arrow, materialize, sliced, text_buffer, tidy, words_of
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 4 coordinates: a pair at similarity 0.8 shares no bucket with probability 5e-8.
BANDS, BAND_ROWS = 32, 4
COORDINATES = BANDS * BAND_ROWS
#: Expected darts per text; coordinates that stay empty get a second, wider throw.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 3))
#: Pairs with one partner that one task verifies.
PARTNER_SHARE = 512
#: Rounds with one partner for each text, before what is left is finished exactly.
PARTNER_ROUNDS = 2
#: Texts and bytes of a block, about, and elements whose overlaps are counted at a time.
BLOCK_ROWS, BLOCK_BYTES, ELEMENTS = 512, 4 << 20, 4_096
#: Texts of a class or of a bucket's lesser classes that a block holds; more are parted.
CROWD = BLOCK_ROWS
#: Elements that two similar texts share, as a part of what both have together.
SHARED = SIMILARITY / (1 + SIMILARITY)
#: Sizes of texts that are filed together differ by an 80th at most.
SIZES = 80
#: Cells in which elements are counted to order them: a fixed size, whatever the corpus.
CELLS = 1 << 18

_POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_UNIT = 2.0**-53


class Shingles:
    """(hash, row) of every shingle of a batch of texts."""

    base = np.uint64(0x2545F4914F6CDD1D)

    def __init__(self) -> None:
        self._hash = RangeHash()
        self._pow = self._inv = powers(1, self.base)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        buf, start, end = text_buffer(column)
        ws, we, row = words_of(buf, start, end)
        n = len(ws)
        if not n:
            return np.zeros(0, dtype=np.uint64), row, len(start)
        if len(self._pow) <= n:
            self._pow, self._inv = powers(n + n // 4 + 2, self.base), powers(n + n // 4 + 2, np.uint64(pow(int(self.base), -1, 1 << 64)))
        self._hash.load(buf)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self._hash.of(ws, we) * self._pow[:n])])
        count = np.bincount(row, minlength=len(start))
        first = np.cumsum(count) - count
        many = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        row = np.repeat(np.arange(len(start)), many)
        to = np.minimum(at + SHINGLE, first[row] + count[row])
        return mix((total[to] - total[at]) * self._inv[at]), row, len(start)


def weighted(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (element, row) and the number of times each occurs."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return key[at], row[at], np.diff(np.append(at, len(key)))


def dart_minhash(element: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, coordinates: int = COORDINATES, darts: int = DARTS) -> np.ndarray:
    """Signatures, rows x coordinates of uint64; weights are positive.  A row without elements gets zeros."""
    out = np.zeros((rows, coordinates), dtype=np.uint64)
    weight = weight.astype(float)
    mass = np.bincount(row, weights=weight, minlength=rows)
    reach = darts / np.maximum(mass, 1e-300)
    todo = mass > 0
    while todo.any():
        own = todo[row]
        e, r, w = element[own], row[own], weight[own]
        # Cells of the weight axis: [0, 1), [1, 2), [2, 4), [4, 8) ...
        cells = 1 + np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64)
        at = np.repeat(np.arange(len(e)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
        width = np.maximum(low, 1.0)
        strips = np.ceil(reach[r[at]] * width).astype(np.int64)
        to = np.repeat(np.arange(len(at)), strips)
        strip = np.arange(len(to)) - np.repeat(np.cumsum(strips) - strips, strips)
        h = mix(e[at][to] + cell[to].astype(np.uint64) * _A + strip.astype(np.uint64) * _B)
        many = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) * _UNIT, side="right")
        dart = np.repeat(np.arange(len(to)), many)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(many) - many, many)
        name = mix(h[dart] + (nth.astype(np.uint64) + np.uint64(1)) * _C)
        more = mix(name ^ _B)
        of = to[dart]
        rank = (strip[dart] + (more >> np.uint64(11)).astype(float) * _UNIT) / width[of]
        rr = r[at[of]]
        inside = (low[of] + (name >> np.uint64(11)).astype(float) * _UNIT * width[of] < w[at[of]]) & (rank <= reach[rr])
        slot = rr[inside] * coordinates + (more[inside] & np.uint64(coordinates - 1)).astype(np.int64)
        rank, name = rank[inside], name[inside]
        best = np.full(rows * coordinates, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        flat = np.zeros(rows * coordinates, dtype=np.uint64)
        flat[slot[won]] = name[won]
        full = todo & np.isfinite(best.reshape(rows, coordinates)).all(axis=1)
        out[full] = flat.reshape(rows, coordinates)[full]
        todo &= ~full
        reach = np.where(todo, reach * 2, reach)
    return out


def node_of(text: Column) -> Column:
    """Name of a text: 128 bits of digest."""
    return F.unhex(F.md5(tidy(text)))


def band_keys(docs: DataFrame) -> DataFrame:
    """(node, keys) of every row with a word; keys has one long per band."""
    made: list[Shingles] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Shingles())
        key, row, rows = made[0].of(batch.column(1))
        element, row, times = weighted(key, row)
        sign = dart_minhash(element, row, times, rows)
        some = np.flatnonzero(np.bincount(row, minlength=rows))
        sign = sign[some].reshape(len(some), BANDS, BAND_ROWS)
        acc = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, (len(some), 1))
        for i in range(BAND_ROWS):
            acc = mix(acc + sign[:, :, i])
        keys = pa.FixedSizeListArray.from_arrays(pa.array(acc.reshape(-1).view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), keys], ["node", "keys"])

    return map_arrow(docs.select("node", "text"), run, "node binary, keys array<bigint>")


def similarities(pairs: DataFrame) -> DataFrame:
    """(u, v, similarity) of pairs (u, v, text_a, text_b): exact weighted Jaccard of shingles."""
    made: list[Shingles] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Shingles())
        ka, ra, rows = made[0].of(batch.column(2))
        kb, rb, _ = made[0].of(batch.column(3))
        ka, ra, ca = weighted(ka, ra)
        kb, rb, cb = weighted(kb, rb)
        key, row = np.concatenate([ka, kb]), np.concatenate([ra, rb])
        count = np.concatenate([ca, cb])
        order = np.lexsort((key, row))
        key, row, count = key[order], row[order], count[order]
        twin = np.flatnonzero((key[1:] == key[:-1]) & (row[1:] == row[:-1]))
        both = np.bincount(row[twin], weights=np.minimum(count[twin], count[twin + 1]), minlength=rows)
        total = np.bincount(row, weights=count, minlength=rows)
        value = both / np.maximum(total - both, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["u", "v", "similarity"])

    return map_arrow(pairs.select("u", "v", "text_a", "text_b"), run, "u binary, v binary, similarity double")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Classes (u, v) of the pairs (a, b, ca, cb) whose texts are similar enough; many pairs with one partner are split among tasks."""
    shares = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / PARTNER_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("share", F.pmod(F.hash("b"), "shares"))
    partner = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    partner = partner.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    member = dealt.select("a", "share", "b", "ca", "cb").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = member.join(partner, ["a", "share"]).withColumns({"u": F.col("ca"), "v": F.col("cb")})
    return similarities(both).where(F.col("similarity") >= SIMILARITY).select("u", "v")


#: A worker's own, made once.
_MADE: list[Shingles] = []


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, row) of texts as plain sets, the nth time of a shingle being an element of its own, and each row's size."""
    if not _MADE:
        _MADE.append(Shingles())
    key, row, rows = _MADE[0].of(column)
    key, row, count = weighted(key, row)
    size = np.bincount(row, weights=count, minlength=rows)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(key, count) + nth.astype(np.uint64) * _A), np.repeat(row, count), size


def _links(table: pa.Table) -> pa.Table:
    """(u, v), a forest of the classes that similar texts join, for rows (class, block, text) of one block or two."""
    rows = len(table)
    element, row, size = _elements(table["text"])
    _, name, often = np.unique(element, return_inverse=True, return_counts=True)
    shared = often > 1
    column = (np.cumsum(shared) - 1)[name][shared[name]]
    row = row[shared[name]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    block = table["block"].to_numpy()
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    both = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, int(shared.sum()), ELEMENTS):
        at = slice(*np.searchsorted(column, [low, low + ELEMENTS]))
        has = np.zeros((rows, min(ELEMENTS, int(shared.sum()) - low)), dtype=np.float32)
        has[row[at], column[at] - low] = 1
        both += has[left] @ has[right].T
    value = both / np.maximum(size[left][:, None] + size[right] - both, 1)
    names = sorted({bytes(c) for c in table["class"].to_pylist()})
    code = np.searchsorted(np.array([c.hex() for c in names]), [bytes(c).hex() for c in table["class"].to_pylist()])
    i, j = np.nonzero(value >= SIMILARITY)
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in np.unique(np.stack([code[left[i]], code[right[j]]]), axis=1).T.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[x] = y
            out.append((names[a], names[b]))
    return pa.table({"u": pa.array([o[0] for o in out], pa.binary()), "v": pa.array([o[1] for o in out], pa.binary())})


def size_edges() -> np.ndarray:
    """The least size of each step of sizes: one size each up to SIZES, then an 80th more each time."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] + max(1, edges[-1] // SIZES))
    return np.array(edges)


def prefixes(texts: DataFrame) -> DataFrame:
    """(key, node, class, bytes, own, low, high): for each of texts (node, class, text) the elements of which a similar text must share one.

    own is the step of the text's size, where the element is one it is filed
    under, else null; low to high are the steps it looks up with the element.
    Of two similar texts the smaller one's own step is among those that the
    larger looks up, with an element that both have.  Any order of elements
    that all texts share will do; rarest first keeps the buckets small.  Rarity
    is counted in CELLS cells, so what every task gets of it has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in sliced(batch):
                total += np.bincount((_elements(part.column(0))[0] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    often = texts.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    rarity = np.zeros(CELLS, dtype=np.int64)
    rarity[often["cell"].to_numpy(dtype=np.int64)] = often["n"].to_numpy(dtype=np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(rarity)

    edges = size_edges()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        element, row, size = _elements(batch.column(2))
        order = np.lexsort((element, shared.value[(element % np.uint64(CELLS)).astype(np.int64)], row))
        element, row = element[order], row[order]
        size = size.astype(np.int64)
        place, long = np.arange(len(row)) - np.searchsorted(row, np.arange(len(size)))[row], size[row]
        step = lambda n: np.searchsorted(edges, n, side="right") - 1
        # The largest partner for which the element still lies in the prefix, and the least that a similar text may be.
        most = np.floor((long - place + 1e-9) / SHARED - long).astype(np.int64)
        least = np.ceil(SIMILARITY * long - 1e-9).astype(np.int64)
        head = np.flatnonzero(most >= least)
        place, long, most, least = place[head], long[head], most[head], least[head]
        filed = place <= long - np.ceil(2 * SHARED * long - 1e-9)
        at = pa.array(row[head])
        size_of = pc.cast(pc.binary_length(batch.column(2)), pa.int64())
        steps = [pa.array(step(long), pa.int32(), mask=~filed), pa.array(step(least), pa.int32()), pa.array(np.minimum(step(long), step(most)), pa.int32())]
        names = ["key", "node", "class", "bytes", "own", "low", "high"]
        return pa.RecordBatch.from_arrays([pa.array(element[head].view(np.int64)), *(c.take(at) for c in (batch.column(0), batch.column(1), size_of)), *steps], names)

    return map_arrow(texts.select("node", "class", "text"), run, "key bigint, node binary, class binary, bytes bigint, own int, low int, high int")


def _by_class(now: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Rows (key, node, class, bytes) with a bucket of its own for each large class and the texts of others that share one of its buckets.

    A large class lies in many buckets that are nearly alike; so its texts meet
    what else is there once, not once a bucket.
    """
    large = materialize(now.select("class", "node").distinct().groupBy("class").count().where(F.col("count") > CROWD).select("class"), "large")
    spent.append(large)
    if large.isEmpty():
        return now
    there = now.join(large, "class").select("key", F.col("class").alias("large")).distinct()
    other = now.join(there, "key").where("class != large").select("large", "node", "class", "bytes")
    own = now.join(large, "class").select(F.col("class").alias("large"), "node", "class", "bytes")
    groups = other.unionByName(own).distinct().select(F.xxhash64(F.lit("class"), "large").alias("key"), "node", "class", "bytes")
    return now.join(large, "class", "left_anti").select("key", "node", "class", "bytes").unionByName(groups)


def _parted(now: DataFrame, texts: DataFrame, spent: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """Rows (key, node, class, bytes) without the buckets of many texts outside their largest class, and rows (key, node, class, bytes, looks) of what prefixes make of those."""
    kinds = now.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    many = materialize(kinds.where(F.col("n") - F.col("top") > CROWD).select("key"), "crowds")
    spent.append(many)
    if many.isEmpty():
        return now, None
    inside = materialize(now.join(many, "key", "left_semi").select("node", "class").distinct(), "crowd-texts")
    heads = materialize(prefixes(texts.join(inside, "node")), "heads")
    spent += [inside, heads]
    # Most elements of a prefix are one text's own: only what several classes have is filed and looked up, in steps that the others' looks and files reach.
    reach = heads.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min("own").alias("f0"), F.max("own").alias("f1"), F.min("low").alias("l0"), F.max("high").alias("l1")).where("c0 < c1")
    reach = reach.where("f0 <= l1 and l0 <= f1").select("key", "f0", "f1", "l0", "l1")
    own, low, high = F.expr("own between l0 and l1"), F.greatest("low", "f0"), F.least("high", "f1")
    heads = heads.join(reach, "key").where(own | (low <= high))
    filed = F.when(own, F.array(F.struct(F.col("own").alias("step"), F.lit(False).alias("looks")))).otherwise(F.array())
    looked = F.transform(_upto(low, high - low + 1), lambda i: F.struct(i.alias("step"), F.lit(True).alias("looks")))
    sides = heads.select("key", "node", "class", "bytes", F.inline(F.concat(filed, looked)))
    both = sides.groupBy("key", "step").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min("looks").alias("s0"), F.max("looks").alias("s1"))
    sides = sides.join(both.where("c0 < c1 and s0 < s1").select("key", "step"), ["key", "step"], "left_semi")
    sides = materialize(sides.select(F.xxhash64("key", "step").alias("key"), "node", "class", "bytes", "looks"), "sides")
    spent.append(sides)
    return now.join(many, "key", "left_anti"), sides


def _once(rows: DataFrame) -> DataFrame:
    """rows with the hashes h and g, by which ``_differing`` tells buckets of equal texts, which would be compared twice."""
    own = [c for c in rows.columns if c not in ("key", "class", "bytes")]
    return rows.withColumns({"h": F.xxhash64(*own), "g": F.xxhash64(F.lit(1), *own)})


def _xors() -> list[Column]:
    return [F.bit_xor(c).alias(c) for c in ("h", "g")]


def _differing(buckets: DataFrame) -> DataFrame:
    """buckets (key, n, h, g and more) without those that equal another one: of equal ones that of least key stays."""
    return buckets.groupBy("n", "h", "g").agg(F.min(F.struct("key", *(c for c in buckets.columns if c not in ("key", "n", "h", "g")))).alias("one")).select("one.*")


def _blocks(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK_ROWS, size / BLOCK_BYTES)).cast("int")


def _upto(low: Column, many: Column) -> Column:
    """An array of so many numbers from low, none for 0."""
    return F.when(many > 0, F.sequence(low, low + many - 1)).otherwise(F.array().cast("array<int>"))


def _met(rows: DataFrame) -> DataFrame:
    """(key, low, high, node, class, block) of blocks low and high that meet, for rows (key, node, class, bytes) of ``_once``."""
    parts = rows.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *_xors())
    buckets = parts.groupBy("key").agg(F.max(F.struct("n", "class", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), *_xors()).where("n > top.n")
    buckets = buckets.select("key", "n", "h", "g", F.col("top.class").alias("major"), _blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("minors"), _blocks(F.col("top.n"), F.col("top.bytes")).alias("majors"))
    buckets = _differing(buckets)
    # Blocks of the largest class meet those of the others only.
    rows = rows.join(buckets, "key").withColumn("in_major", F.col("class") == F.col("major"))
    own = F.xxhash64("key", "node")
    rows = rows.withColumn("block", F.when(F.col("in_major"), F.col("minors") + F.pmod(own, "majors")).otherwise(F.pmod(own, "minors")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("in_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    met = rows.select("key", "node", "class", "block", F.explode(others).alias("other"))
    return met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "class", "block")


def _looked_up(rows: DataFrame) -> DataFrame:
    """The same for rows (key, node, class, bytes, looks) of ``_once``: blocks of filed texts meet blocks of those that look them up.

    Filed texts' blocks come first, those of the largest class after the others,
    then the blocks of texts that look up, in the same order.
    """
    sums = {f"{name}{side}": F.sum(F.when(F.col("looks") == bool(side), value).otherwise(0)) for side in (0, 1) for name, value in (("n", F.lit(1)), ("b", F.col("bytes")))}
    parts = rows.groupBy("key", "class").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in sums.items()), *_xors())
    buckets = parts.groupBy("key").agg(F.max(F.struct("n", "class", *sums)).alias("top"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums), *_xors())
    number = [_blocks(v - F.col(f"top.n{side}") if rest else F.col(f"top.n{side}"), w - F.col(f"top.b{side}") if rest else F.col(f"top.b{side}")) for side in (0, 1) for v, w in [(F.col(f"n{side}"), F.col(f"b{side}"))] for rest in (True, False)]
    buckets = buckets.select("key", "n", "h", "g", F.col("top.class").alias("major"), *(v.alias(name) for name, v in zip(("filed", "filed_major", "look", "look_major"), number)))
    buckets = _differing(buckets.where("filed > 0 and look + look_major > 0 or filed_major > 0 and look > 0"))
    rows = rows.join(buckets, "key").withColumn("in_major", F.col("class") == F.col("major"))
    first = F.col("filed") + F.col("filed_major")
    begin = F.when(F.col("looks"), first).otherwise(F.lit(0)) + F.when(F.col("in_major"), F.when(F.col("looks"), F.col("look")).otherwise(F.col("filed"))).otherwise(F.lit(0))
    many = F.when(F.col("looks"), F.when(F.col("in_major"), F.col("look_major")).otherwise(F.col("look"))).otherwise(F.when(F.col("in_major"), F.col("filed_major")).otherwise(F.col("filed")))
    rows = rows.withColumn("block", (begin + F.pmod(F.xxhash64("key", "node"), many)).cast("int"))
    lookers = F.col("look") + F.when(F.col("in_major"), F.lit(0)).otherwise(F.col("look_major"))
    kept = F.col("filed") + F.when(F.col("in_major"), F.lit(0)).otherwise(F.col("filed_major"))
    others = F.when(F.col("looks"), _upto(F.lit(0), kept)).otherwise(_upto(first, lookers))
    met = rows.select("key", "node", "class", "block", F.explode(others).alias("other"))
    return met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "class", "block")


def _finished(now: DataFrame, texts: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """Links (u, v) of all similar texts of different classes that share a bucket, for rows (key, node, class); spent gets what it writes."""
    rows = materialize(now.join(texts.select("node", F.octet_length("text").cast("bigint").alias("bytes")), "node").select("key", "node", "class", "bytes"), "open")
    spent.append(rows)
    rows, sides = _parted(_by_class(rows, spent), texts, spent)
    met = _met(_once(rows))
    if sides is not None:
        met = met.unionByName(_looked_up(_once(sides)))
    met = met.join(texts, "node").select("key", "low", "high", "class", "block", "text")
    return met.groupBy("key", "low", "high").applyInArrow(_links, "u binary, v binary").distinct()


def _partners(now: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of texts and their classes for rows (key, node, class): no more than there are texts.

    A bucket's lead is the first of its texts in an order that all buckets of
    the round share, so copies that share many buckets have few leads.  A text
    meets the lead that it shares most buckets with.
    """
    order = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))
    one = now.groupBy("key", "class").agg(F.min(order)["node"].alias("node")) if turn else now
    lead = one.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("class"))).alias("lead"))
    met = one.join(lead, "key").where("class != lead.class")
    met = met.groupBy("node", "class", F.col("lead.order.node").alias("a"), F.col("lead.class").alias("ca")).agg(F.count("*").alias("n"))
    best = met.groupBy("node", "class").agg(F.max(F.struct("n", "a", "ca")).alias("best"))
    return best.select(F.col("best.a").alias("a"), F.col("node").alias("b"), F.col("best.ca").alias("ca"), F.col("class").alias("cb"))


def classes(docs: DataFrame) -> DataFrame:
    """(node, root) of every text that is similar to another, for docs (node, text) with copies."""
    keys = band_keys(docs).groupBy("node").agg(F.first("keys").alias("keys"))
    bands = materialize(keys.select("node", F.explode("keys").alias("key")), "bands")
    crowded = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    rows = materialize(bands.join(crowded, "key"), "buckets")
    wanted = rows.select("node").distinct()
    texts = docs.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    forget(bands)
    relabel = lambda df, moved: df.join(moved.withColumnRenamed("node", "class"), "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")
    now, old = rows.withColumn("class", F.col("node")), [rows]
    moves: list[DataFrame] = []
    # What is used twice is written first: the driver holds the plan of one step at a time.
    for turn in range(PARTNER_ROUNDS + 1):
        if turn == PARTNER_ROUNDS:
            # What is left is what buckets of several classes hold; the rounds find no partner in the others.
            several = now.groupBy("key").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 < c1").select("key")
            fresh = materialize(_finished(now.join(several, "key", "left_semi"), texts, old), "links")
        else:
            pairs = materialize(_partners(now, turn), "pairs")
            fresh = materialize(_verified(pairs, texts).distinct(), "links")
            forget(pairs)
        moves.append(materialize(components(fresh), "classes"))
        forget(fresh)
        if turn < PARTNER_ROUNDS:
            now = materialize(relabel(now, moves[-1]).select("key", "node", "class"), "buckets")
            forget(*old)
            old = [now]
    found = texts.select("node").withColumn("class", F.col("node"))
    for moved in moves:
        found = relabel(found, moved)
    found = materialize(found.select("node", F.col("class").alias("root")), "found")
    forget(*old, *moves, texts)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size (rows) and kept, for every row of docs.

    kept marks the rows whose doc_id names their class; callers that need one
    row exactly take ``one_of_each``.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), node_of(F.col("text")).alias("node"), tidy(F.col("text")).alias("text"))
    found = classes(named.select("node", "text"))
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    whole = nodes.select("node", "root").join(groups, "root").select("node", "class_id", "class_size")
    return named.select("doc_id", "node").join(whole, "node").select("doc_id", "class_id", "class_size", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class, the one of least doc_id (nulls last), with the columns of docs."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    flat = flat.withColumn("node", node_of(text))
    found = classes(flat.select("node", tidy(text).alias("text")))
    nodes = flat.groupBy("node").agg(F.min(doc_id).alias("least"))
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = nodes.groupBy("root").agg(F.min_by(F.struct("node", "least"), F.struct(F.col("least").isNull(), "least", "node")).alias("w")).select("w.*")
    kept = flat.join(winners, "node").where(doc_id.eqNullSafe(F.col("least")))
    return kept.dropDuplicates(["node"]).select(*names).toDF(*docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
