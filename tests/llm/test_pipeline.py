"""The pipeline's stages on a small corpus: decisions take effect, clean documents stay, nothing is lost between stages."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing, packing, registry

from .conftest import DOCS, edge_rows, prose
from .test_text_operators import true_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(100 + i, 200 + 10 * (i % 7)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1", 1), (101, rows[1][1] + " tail", "en", "s1", 1)]  # an exact and a near copy
    rows += [(102, "too short", "en", "s1", 1), (103, "again and again " * 60, "en", "s1", 1)]
    rows += [(104, prose(900, 150) + " mail me at bob.x@mail.example.com", "en", "s2", 1)]
    rows += [(110 + i, " ".join(w + "***" for w in prose(700 + i, 100).split()), "en", "s0", 1) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i in range(50)] + [(110 + i, 0, 0) for i in range(35)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    docs = stage["quality rules"](spark, docs, corpus)
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids == {*range(60), 100, 101, 104} and docs.columns == columns
    docs = stage["near-duplicates"](spark, docs, corpus)
    assert {r["doc_id"] for r in docs.collect()} == {*range(60), 104} and docs.columns == columns
    docs = stage["personal data"](spark, docs, corpus)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[104].endswith("mail me at [EMAIL]") and docs.columns == columns
    mixed = stage["mixing"](spark, docs, corpus)
    words = sum(len(WORD.findall(r["text"])) for r in mixed.collect())
    assert mixed.columns == columns and abs(words - sum(len(WORD.findall(t)) for t in texts.values())) < 3 * 64
    packed = stage["packing"](spark, mixed, corpus).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def pieces_of(ids, size=1024):
    """(piece, start, length, checksum) of one document's ids; only the first piece may be shorter."""
    head = len(ids) % size or size
    cuts = [0, *range(head, len(ids) + 1, size)]
    return [(i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def test_mixing_returns_a_small_plan(spark, corpus, capsys):
    """What it is made of is written before: as one plan the scans and broadcasts of all of it lay in the driver at once."""
    mixing.mixed_documents(spark, spark.read.parquet(f"{corpus}/documents.parquet"), corpus).explain()
    assert 0 < capsys.readouterr().out.count("FileScan") <= 2


def test_run_equals_brute_force(spark, corpus, tmp_path):
    """Rules, classes and redaction by loops, the mix of what they leave, the library's ids: the rows of run()."""
    rng = np.random.default_rng(8)
    template = prose(4000, 220).split()
    family = []
    for i in range(50):
        words = list(template)
        for at in rng.choice(220, size=int(rng.integers(0, 14)), replace=False):
            words[at] = f"w{i}x{at}"
        family.append((300 + i, " ".join(words), "en", "s0", 1))
    rows = [tuple(r) for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()] + family
    top = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{top}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{top}/labels.parquet")
    left = [r for r in rows if r[0] < 100 or r[0] in (100, 101, 104) or r[0] >= 300]
    classes = true_classes([r[:2] for r in left])
    kept = [r for r, (i, least, _) in zip(left, classes) if i == least]
    assert 1 < sum(r[0] >= 300 for r in kept) < 50  # the family is neither one class nor all apart
    kept = [(r[0], r[1].replace("bob.x@mail.example.com", "[EMAIL]"), *r[2:]) for r in kept]
    mixed = mixing.mixed_documents(spark, spark.createDataFrame(kept, DOCS), top).collect()
    encode = Tokenizer.from_file(packing.vocabulary())
    want = Counter((r["doc_id"], *p) for r in mixed for p in pieces_of([*encode.encode(r["text"], add_special_tokens=False).ids, 2]))
    got = corpus_pipeline.run(spark, top).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(held))])
        assert [at for at, _ in sorted(held)] == ends[:-1].tolist() and ends[-1] <= 1024


def test_run_on_awkward_tables(spark, edge, empty, labels, tmp_path):
    for name, docs in (("edge", edge), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        ids = {r[0] for r in edge_rows()}
        assert {r["doc_id"] for r in got} <= ids and bool(got) == (name == "edge")


def test_registry_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
