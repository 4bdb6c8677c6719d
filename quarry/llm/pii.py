"""Personal data: base patterns, and boosted trees over wider candidates.

Everything on the main path is a projection of built-in functions, row by row:
no shuffle and no Python.  ``split`` and ``regexp_extract_all`` with one
pattern give the pieces between matches and the matches; their lengths give
positions in code points.  High-recall generators propose spans, several of
which may overlap; a small gradient-boosted model, trained here on generated
examples whose features the same expressions compute, scores format and
context; spans over their kind's calibrated threshold are added to the base
ones unless they touch one.

Defined results: a null text counts as empty and has no spans; other columns,
null ids and repeated rows pass row by row; an empty table gives an empty
result.  Offsets are code points, end exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted, fit
from .common import documents, tidy

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive loops keep them linear and off the stack; a run of an e-mail's or an address's first
#: characters is tried once, from its start or from where the last match ended, since later starts fail alike.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Texts without these have no match, so the costly patterns skip them.
GATE = ("@", "[0-9]", "[0-9]", "\\+")
#: High-recall generators; what they find may overlap.
AT = r"(?:@|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20)"
WIDE = (
    rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++{AT}[a-z0-9-]++(?:{DOT}[a-z0-9-]++)++",
    r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:[.:,\x20]{1,2}[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:{1,2}){3,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{2,6}){2,4})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z.])(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20./-]{0,2}[0-9]{3,4}[\x20./-]{0,2}[0-9]{3,4}(?![0-9A-Za-z])",
)
#: Part of what each generator must match: texts without it have no match.
WIDE_GATE = (rf"(?i){AT}[a-z0-9-]++{DOT}[a-z0-9-]", "[0-9]", "[0-9]", "[0-9]")
CUES = (r"(?i)mail|contact|write|reach", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|payment|master|amex", r"(?i)phone|tel|call|fax|mobile|cell|dial")
AGAINST = r"(?i)isbn|order|version|\bv\b|date|id\b|serial|invoice|item|total|part|#|\$|password|token|key"
FEATURES = ("kind", "digits", "groups", "length", "separators", "luhn", "bytes_ok", "has_at", "letters", "glued_left", "glued_right", "cue", "against", "lead", "spelt", "bracket", "longest")
#: Generated examples the trees are fitted on, and the least held-out precision a threshold must have.
EXAMPLES, PRECISION = 2400, 0.97


def _matches(text: Column, pattern: str, gate: str) -> Column:
    """array<struct<start, end, found>> of a pattern's matches, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.arrays_zip(found.alias("m"), between.alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["p"])
        b = a + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("found")))).alias("out")))

    spans = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(F.contains(text, F.lit("@")) if gate == "@" else text.rlike(gate), spans).otherwise(start["out"])


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits, with one digit at least, passes Luhn's check."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _bytes_ok(found: Column) -> Column:
    """Whether every run of digits is at most 255."""
    parts = F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))
    small = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(parts, lambda p: F.when(F.length(small(p)) > 3, F.lit(False)).otherwise(small(p).cast("int") <= 255))


def _passes(kind: int, found: Column) -> Column:
    digits = _digits(found)
    if kind == 1:
        return _bytes_ok(found)
    if kind == 2:
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(8, 15) if kind == 3 else F.lit(True)


def _kinded(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def _features(text: Column, c: Column) -> Column:
    """struct of FEATURES as doubles for a candidate c of text."""
    found, digits = c["found"], _digits(c["found"])
    left = F.substring(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))
    before = F.substring(text, c["start"], F.when(c["start"] > 0, 1).otherwise(0))
    after = F.substring(text, c["end"] + 1, F.lit(1))
    cue = F.lit(False)
    for k in range(len(KINDS)):
        cue = cue | ((c["kind"] == k) & left.rlike(CUES[k]))
    runs = F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))
    values = {
        "kind": c["kind"], "digits": F.length(digits), "groups": F.size(runs), "length": F.length(found),
        "separators": F.size(F.array_distinct(F.regexp_extract_all(found, F.lit("[^0-9A-Za-z]"), F.lit(0)))),
        "luhn": F.when(F.length(digits).between(1, 40), _luhn(digits)).otherwise(F.lit(False)), "bytes_ok": _bytes_ok(found), "has_at": F.contains(found, F.lit("@")),
        "letters": F.length(F.regexp_replace(found, "[^A-Za-z]", "")), "glued_left": before.rlike(r"[0-9A-Za-z=/_:.#$-]"), "glued_right": after.rlike(r"[0-9A-Za-z=/_:%-]"),
        "cue": cue, "against": left.rlike(AGAINST), "lead": F.when(F.length(digits) > 0, F.substring(digits, 1, 1).cast("int")).otherwise(F.lit(-1)),
        "spelt": found.rlike(r"(?i)[(\[{\x20](?:at|dot)[)\]}\x20]"), "bracket": found.rlike("[(+]"), "longest": F.array_max(F.transform(F.concat(runs, F.array(F.lit(""))), F.length)),
    }
    return F.struct(*(F.coalesce(values[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


def _with_candidates(df: DataFrame) -> DataFrame:
    """Adds base (spans of the base patterns) and cand (wider spans that touch none of them, with features) to df (text_, ...)."""
    text = F.col("text_")
    passing = lambda k: lambda s: _passes(k, s["found"])
    for k, (pattern, gate) in enumerate(zip(BASE, GATE)):
        df = df.withColumn(f"base{k}", F.filter(_kinded(_matches(text, pattern, gate), k), passing(k)))
    df = df.withColumn("base", F.concat(*(F.col(f"base{k}") for k in range(4))))
    for k, (pattern, gate) in enumerate(zip(WIDE, WIDE_GATE)):
        df = df.withColumn(f"wide{k}", _kinded(_matches(text, pattern, gate), k))
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    df = df.withColumn("wide", F.concat(*(F.col(f"wide{k}") for k in range(4))))
    df = df.withColumn("wide", F.filter("wide", lambda c: ~F.exists("base", lambda b: touches(c, b))))
    return df.withColumn("cand", F.transform("wide", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _features(text, c).alias("x"))))


def examples(seed: int = 5, n: int = EXAMPLES) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, personal) generated for training: look-alikes of each kind, in plain prose."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick(*"abcdefghijklmnoprstuvw") for _ in range(int(rng.integers(2, 8))))

    def card(valid: bool) -> str:
        body = pick("4", "5", "37", "6")
        body += digits(15 - len(body))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(ch) for ch in reversed(body)))
        last = -total % 10
        whole = body + str(last if valid else (last + int(rng.integers(1, 10))) % 10)
        sep = pick(".", "_", "/", "  ", "")
        if not sep:  # two in a row are too many digits for the base pattern
            return f"{whole} {whole}"
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4))

    out = []
    for i in range(n):
        kind, good = i % 4, bool(rng.random() < 0.5)
        cue, wrong = "", ""
        if kind == 0:
            at, dot = pick((" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", "."))
            span = f"{word()}{pick('', '.' + word(), digits(2))}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'fr')}" if good else pick(f"{word()} at {word()} {word()}.{word()}", f"{word()} at {word()}.{pick('com', 'org', 'net')}", f"{word()} dot {word()}", f"{word()} at {word()}.{digits(1)}")
            cue = pick("mail ", "contact ", "write to ", "")
        elif kind == 1:
            byte = lambda: str(int(rng.integers(1, 256)))
            span = pick(":".join("%x" % int(rng.integers(4096, 65536)) for _ in range(8)), " . ".join(byte() for _ in range(4)).replace(" . ", pick(". ", " ."))) if good else pick(f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", ", ".join(digits(3) for _ in range(4)), " ".join(digits(int(rng.integers(1, 4))) for _ in range(4)))
            cue, wrong = pick("ip ", "host ", "server ", ""), pick("version ", "items ", "at ", "")
        elif kind == 2:
            span = card(good)
            cue, wrong = pick("card ", "visa ", "credit card ", ""), pick("order ", "serial ", "invoice ", "")
        else:
            a, b, c = digits(3), digits(3), digits(4)
            span = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a}/{b}{c}", f"00{digits(2)} {a} {b} {c}") if good else pick(f"{digits(4)}-{digits(2)}{digits(1)}-{digits(3)}", f"{digits(3)}{digits(4)}{digits(3)}", f"{digits(2)}.{digits(3)}.{digits(3)}", digits(9), f"{digits(3)} {digits(3)} {digits(3)}")
            cue, wrong = pick("call ", "phone ", "tel ", "mobile ", ""), pick("order ", "isbn ", "total ", "date ", "")
        lead = " ".join(word() for _ in range(int(rng.integers(1, 9)))) + " " + (cue if good else wrong)
        tail = pick("", ".", ",") + " " + " ".join(word() for _ in range(int(rng.integers(0, 6))))
        out.append((lead + span + tail, kind, len(lead), len(lead) + len(span), int(good)))
    return out


def train(spark: SparkSession) -> tuple[Boosted, list[float]]:
    """The model and each kind's threshold on the logit; the same every time."""
    rows = spark.createDataFrame(examples(), "text_ string, kind int, a int, b int, good int")
    found = _with_candidates(rows).select("kind", "a", "b", "good", F.explode("cand").alias("c"))
    # A proposal of another kind, or one that misses part of the planted span, is a wrong one; but a whole card of two is right.
    whole = (F.col("c.start") <= F.col("a")) & (F.col("c.end") >= F.col("b"))
    within = (F.col("kind") == 2) & (F.col("c.start") >= F.col("a")) & (F.col("c.end") <= F.col("b")) & F.col("c.x.digits").between(13, 19)
    right = (F.col("good") == 1) & (F.col("c.kind") == F.col("kind")) & (whole | within)
    data = found.select("c.kind", right.cast("int").alias("y"), *(F.col(f"c.x.{f}").alias(f"x_{f}") for f in FEATURES)).toPandas()
    data = data.sort_values(list(data.columns)).reset_index(drop=True)
    x, y = data[[f"x_{f}" for f in FEATURES]].to_numpy(dtype=float), data["y"].to_numpy()
    model, held = fit(x, y)
    logit = model.slope * model.raw(x) + model.offset
    thresholds = []
    for k in range(len(KINDS)):
        own = held & (data["kind"].to_numpy() == k)
        order = np.argsort(-logit[own], kind="stable")
        score, hit = logit[own][order], y[own][order]
        good = np.flatnonzero(np.cumsum(hit) / np.arange(1, len(hit) + 1) >= PRECISION)
        thresholds.append(max(0.0, float(score[good[-1]])) if len(good) else float("inf"))
    return model, thresholds


def find_spans(docs: DataFrame, model: Boosted, thresholds: list[float], *, text: str = "text") -> DataFrame:
    """docs with base and spans, arrays of struct<kind, start, end> in order of kind and start."""
    df = _with_candidates(docs.withColumn("text_", tidy(F.col(text))))
    score = lambda c: model.logit([c["x"][f] for f in FEATURES])
    over = lambda c: F.array(*(F.lit(t) for t in thresholds))[c["kind"]]
    df = df.withColumn("scored", F.transform("cand", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), score(c).alias("p"), over(c).alias("t"))))
    df = df.withColumn("scored", F.filter("scored", lambda c: c["p"] >= c["t"]))
    # Of proposals that overlap, the most probable stays; on a tie the first.
    beats = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((a["p"] > b["p"]) | (a["p"] == b["p"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & ((a["end"] > b["end"]) | (a["end"] == b["end"]) & (a["kind"] < b["kind"]))))
    df = df.withColumn("added", F.filter("scored", lambda b: ~F.exists("scored", lambda a: beats(a, b))))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return df.withColumn("base", plain("base")).withColumn("spans", F.array_sort(F.concat("base", plain("added"))))


def _joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs with every span of personal data replaced by its kind in brackets; n_chars follows the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    df = find_spans(flat, *train(spark), text=text).withColumn("ordered", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text_"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], tags[s["kind"]]).otherwise(F.lit(""))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("ordered", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text_"), acc["at"] + 1, F.length("text_"))))
    df = df.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        df = df.withColumn(n, F.when(F.size("spans") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return df.select(*names).toDF(*docs.columns)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    df = find_spans(docs, *train(spark))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    df = df.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
    return df
