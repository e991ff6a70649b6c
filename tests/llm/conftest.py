import random

import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(7)
    words = [f"w{k:03d}" for k in range(400)] + ["öl", "über", "дом", "город", "naïve", "日本"]
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 160))) for _ in range(25)]
    shared = " ".join(rng.choices(words, k=140))
    texts = ["", None, " \t\n ", "!!! 123", "one", "One", "one two", *prose, prose[3], prose[3], prose[4] + " tail", prose[5].upper()]
    texts += [f"{prose[0]} {shared} end", f"start {shared} {prose[1]}", "ab" * 700, "x" * 399, "y" * 400, "z" * 401, " ".join(rng.choices(words, k=9000))]
    rows = [(k, t, ["en", "de", None][k % 3], ["hot", None][k % 2], None if t is None else len(t)) for k, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, "a row without an id " * 30, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Columns named like those that operators make inside."""
    from pyspark.sql import functions as F

    names = ["id", "t", "h", "hash", "digest", "data", "words", "raw", "tpl", "key", "spans", "kind", "bucket", "component", "n", "k", "range", "guest", "units", "entity", "identity", "seed", "ids", "score", "votes", "copies", "whole", "Row", "__found", "__t", "News", "Of", "pos"]
    return awkward.withColumns({c: F.lit(f"clash {c}") for c in names})
