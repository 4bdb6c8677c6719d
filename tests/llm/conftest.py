import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abdeglmnorstu"), size=int(k))) for k in rng.integers(2, 8, 400)]
    return " ".join(words[i] for i in rng.integers(0, 400, n))


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near and exact copies."""
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "changed"
    odd = "naïve café 日本語 'quotes' don't \U0001f600 a b tab\tend\r\n\nline"
    return [
        (1, base, "en", "s1", 10), (2, base, "en", "s1", 10), (3, " ".join(near), "en", "s2", None), (4, None, None, None, None), (5, "", "en", "s1", 0), (6, "   \n\t ", "fr", "s2", 5),
        (7, odd, "de", "s3", len(odd)), (8, "one", "en", "s1", 3), (9, "line\n" * 40 + "other words here " * 30, "en", None, 1), (None, base, "en", "s1", 10), (None, "null id text with some words", None, "s9", 1),
        (10, prose(2, 30_000), "en", "s1", 9), (11, "x" * 50_000, "en", "s2", 50_000), (12, "same row " * 30, "en", "s1", 2), (12, "same row " * 30, "en", "s1", 2), (12, "other text of the id " * 20, "en", "s1", 2),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "k", 7, 1.5, "t") for r in edge_rows()], DOCS + ", key string, node int, taken double, term string").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
