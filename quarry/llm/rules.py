"""Quality rules as learned decision lists.

``text_statistics`` counts what rules are made of.  ``learn_rules`` grows and
prunes threshold conjunctions by sequential covering on labelled statistics:
each rule takes the condition of most information gain until it covers no good
row of the growing part, is pruned back on the pruning part, and is kept while
its precision there holds; the rows it covers then leave.  ``verdict`` turns
the list into one ordered Spark conditional expression, so scoring a corpus is
a projection without a shuffle.

Defined results: a null or empty text has no words, so it fails the base rule;
null ids and repeated rows pass through row by row; an empty table gives an
empty result; without usable labels the list is empty and only the base rule
rejects; columns of the input beyond ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import RangeHash, mix, powers, string_codes
from .common import documents, map_arrow, text_buffer, words_of

#: Labelled rows that rules are fitted on, at most; taken in order of a hash of doc_id.
FIT_ROWS = 20_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_punct", "n_distinct_words", "n_same_as_last")
SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC3:0xCA] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b"!?.,;:")] = True


def _statistics():
    """A function from a batch (doc_id, text) to its counts."""
    hashes = RangeHash()
    state = {"pow": powers(1, np.uint64(3)), "inv": powers(1, np.uint64(3))}
    base = np.uint64(0x2545F4914F6CDD1D)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, start, end = text_buffer(batch.column(1))
        rows = len(start)
        ws, we, row = words_of(buf, start, end)

        def per_doc(flags: np.ndarray) -> np.ndarray:
            upto = np.concatenate([[0], np.cumsum(flags)])
            return upto[end] - upto[start]

        count = lambda where, weights=None: np.bincount(where, weights=weights, minlength=rows).astype(np.int64)
        n_words = count(row)
        hashes.load(buf)
        inside = np.zeros(len(buf) + 1, dtype=np.int8)
        inside[ws] += 1
        np.add.at(inside, we, -1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        lead = (buf & 0xC0) != 0x80
        word_hash = hashes.of(ws, we)
        code = string_codes(buf, ws, we, word_hash)
        salt = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        # Windows of WINDOW words inside a text.
        n = len(ws)
        if len(state["pow"]) <= n:
            state["pow"], state["inv"] = powers(n + n // 4 + 2, base), powers(n + n // 4 + 2, inverse)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word_hash * state["pow"][:n])])
        n_repeat = np.zeros(rows, dtype=np.int64)
        if n >= WINDOW:
            at = np.flatnonzero(row[WINDOW - 1 :] == row[: n - WINDOW + 1])
            key = mix((total[at + WINDOW] - total[at]) * state["inv"][at] + salt[at])
            order = np.argsort(key)
            a, b = at[order[1:]], at[order[:-1]]
            same = (key[order][1:] == key[order][:-1]) & (row[a] == row[b])
            for k in range(WINDOW):  # equal words, not equal hashes only
                same &= code[a + k] == code[b + k]
            twice = np.zeros(len(at), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, dtype=np.int64)
            np.add.at(cover, at[twice], 1)
            np.add.at(cover, at[twice] + WINDOW, -1)
            n_repeat = count(row[np.cumsum(cover[:-1]) > 0])
        distinct = np.unique(row * (int(code.max(initial=0)) + 1) + code, return_index=True)[1]
        again = np.zeros(n, dtype=bool)
        if n:
            again[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
        # Lines with a word, equal to an earlier line of the text.
        cuts = np.zeros(len(buf) + 1, dtype=bool)
        cuts[np.flatnonzero(buf == 10) + 1] = True
        cuts[start] = True
        ls = np.flatnonzero(cuts[: len(buf)])
        le = np.concatenate([ls[1:], [len(buf)]])
        line_row = np.searchsorted(end, ls, side="right")
        le = le - ((le > ls) & (buf[np.maximum(le - 1, 0)] == 10)) if len(buf) else le
        has_word = np.searchsorted(ws, le) > np.searchsorted(ws, ls)
        ls, le, line_row = ls[has_word], le[has_word], line_row[has_word]
        line = string_codes(buf, ls, le, hashes.of(ls, le))
        line_key = line_row * (int(line.max(initial=0)) + 1) + line
        n_lines = count(line_row)
        n_dup = n_lines - count(line_row[np.unique(line_key, return_index=True)[1]])
        out = {
            "n_words": n_words, "word_chars": per_doc(inside & lead), "n_symbols": per_doc(_SYMBOL[buf]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": n_lines,
            "n_upper": per_doc(_UPPER[buf]), "n_letters": per_doc(_LETTER[buf]), "n_digits": per_doc(_DIGIT[buf]), "n_punct": per_doc(_PUNCT[buf]), "n_distinct_words": count(row[distinct]), "n_same_as_last": count(row[again]),
        }
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    return run


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row; whole texts, one pass, no shuffle."""
    made: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(_statistics())
        return made[0](batch)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, SCHEMA)


#: Ratios that rules put thresholds on: (name, numerator, denominator).
RATIOS = (
    ("chars_per_word", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_word_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "n_letters"),
    ("digits_per_word", "n_digits", "n_words"),
    ("punct_per_word", "n_punct", "n_words"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("same_as_last_share", "n_same_as_last", "n_words"),
    ("words", "n_words", None),
)


def ratio(top: str, bottom: str | None) -> Column:
    value = F.col(top).cast("double")
    return value if bottom is None else value / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold


def _covered(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), dtype=bool)
    for c in rule:
        mask &= c.holds(x)
    return mask


def _grow(x: np.ndarray, bad: np.ndarray, max_conditions: int, cuts: int) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    mask = np.ones(len(x), dtype=bool)
    while len(rule) < max_conditions and (~bad[mask]).any():
        p0, n0 = bad[mask].sum(), (~bad[mask]).sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            values = x[mask, f]
            for t in np.unique(np.quantile(values, np.linspace(0.01, 0.99, cuts))):
                for above in (True, False):
                    c = values > t if above else values <= t
                    p, n = bad[mask][c].sum(), (~bad[mask])[c].sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = Condition(f, above, float(t)), g
        if best is None:
            break
        rule += (best,)
        mask &= best.holds(x)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3, cuts: int = 41, seed: int = 7) -> list[tuple[Condition, ...]]:
    """Ordered conjunctions; a row that any of them covers is bad."""
    rules: list[tuple[Condition, ...]] = []
    rng = np.random.default_rng(seed)
    left = np.ones(len(x), dtype=bool)
    while len(rules) < max_rules and bad[left].sum() >= min_cover:
        rows = np.flatnonzero(left)
        part = rng.random(len(rows)) < 2 / 3
        grow, prune = rows[part], rows[~part]
        rule = _grow(x[grow], bad[grow], max_conditions, cuts)

        def worth(r: tuple[Condition, ...], prune: np.ndarray = prune) -> float:
            hit = bad[prune][_covered(r, x[prune])]
            return (hit.sum() - (~hit).sum()) / len(hit) if len(hit) else -1.0

        while len(rule) > 1 and (shorter := max((rule[:k] for k in range(1, len(rule))), key=worth)) and worth(shorter) >= worth(rule):
            rule = shorter
        hit = bad[left][_covered(rule, x[left])] if rule else np.zeros(0, dtype=bool)
        if len(hit) < min_cover or hit.mean() < min_precision:
            break
        rules.append(rule)
        left[left] = ~_covered(rule, x[left])
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """Number of the first rule that rejects a row, null if none does."""
    out = F
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for c in rule:
            name, top, bottom = RATIOS[c.feature]
            value = ratio(top, bottom)
            test = test & (value > F.lit(c.threshold) if c.above else value <= F.lit(c.threshold))
        out = out.when(test, F.lit(i + 1))
    return F.lit(None).cast("int") if out is F else out.otherwise(F.lit(None).cast("int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of docs that have a label (least label of an id counts), with ``columns`` of labels."""
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*(F.min(F.col(c).cast("int")).alias(c) for c in columns))
    ids = ids.dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # bounded: safe to broadcast
    found = docs.join(F.broadcast(ids), "doc_id")
    # An id may have any number of rows: the limit holds for rows too, the same ones every time.
    mark = F.xxhash64(*found.columns)
    return found.orderBy(F.xxhash64("doc_id"), mark).limit(limit)


def fit_rules(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> list[tuple[Condition, ...]]:
    """Rules for quality = 0 from the statistics of at most fit_rows labelled ids."""
    picked = labelled_sample(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), labels.select("doc_id", "quality"), ["quality"], fit_rows)
    # quality rides in doc_id: the statistics keep that column as it is.
    stats = text_statistics(picked.select(F.col("quality").cast("bigint").alias("doc_id"), "text"))
    rows = stats.where(~base_failed()).select("doc_id", *(ratio(t, b).alias(n) for n, t, b in RATIOS)).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)  # the same rules whatever order rows came in
    return learn_rules(rows[[n for n, _, _ in RATIOS]].to_numpy(dtype=float), rows["doc_id"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the first that rejects) and kept of every row of docs."""
    stats = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return stats.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of docs whose text the rules keep, with the columns they had."""
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return filter_docs(docs, rules)


def filter_docs(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """The rows of docs that the rules keep; statistics and rows travel together, so nothing is joined."""
    made: list = []
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    schema = flat.schema.simpleString()[len("struct<") : -1] + "," + ",".join(f"{c}:bigint" for c in COUNTS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(_statistics())
        at = batch.schema.names.index(text)
        own = made[0](pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"]))
        return pa.RecordBatch.from_arrays([*batch.columns, *own.columns[1:]], [*names, *COUNTS])

    fields = ",".join(x.replace(":", " ", 1) for x in _split(schema))
    rated = map_arrow(flat, run, fields).withColumn("rule", verdict(rules))
    return rated.where(~base_failed() & F.col("rule").isNull()).select(*names).toDF(*docs.columns)


def _split(fields: str) -> list[str]:
    """Top-level fields of a struct's simple string."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(fields[at:i])
            at = i + 1
    return [*out, fields[at:]]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
