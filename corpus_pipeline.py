"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again for the next one.

Defined results: a document with a null or empty text has no words and fails
the rules; of equal or similar texts the row of least doc_id stays, a null one
only where no other has an id; rows alike in doc_id and text become one; extra
columns pass up to packing, which returns pieces; an empty table, or one whose
every document is rejected, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, near_dups, packing, pii, rules
from quarry.llm.common import documents, materialize

STAGES = [
    ("quality rules", rules.keep_good),
    ("near-duplicates", near_dups.one_of_each),
    ("personal data", pii.redact),
    ("mixing", mixing.mixed_documents),
    ("packing", packing.pack_documents),
]

#: Learned rules, hashes and models decide; SQL cannot express them.  tests/llm holds run()'s rows against loops over a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
