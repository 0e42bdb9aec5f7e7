"""Awkward documents that every operator has to take."""

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size string, hash string, row string, "
          "k string, h string, f0 string, y string, score string, row_id string, slice string, fingerprint string")


def frame(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, source); the other columns hold clashing names."""
    width = len(schema.split(", "))
    return spark.createDataFrame([(i, t, "en", s, None, *["x"] * (width - 5)) for i, t, s in rows], schema)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_rows():
    passage = " ".join(f"passage{i}" for i in range(60))
    return [
        (1, passage + " one", "a"), (2, "before " + passage, "b"), (2, "before " + passage, "b"), (3, None, None), (4, "", "a"),
        (5, " \t\n", "c"), (None, passage, "a"), (None, None, None), (6, "word", "a"), (7, "a b été x@y.org", "b"),
        (8, " ".join(f"w{i % 977}" for i in range(60_000)), "b"), (9, "z" * 200_000, "a"), (10, passage + " one", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: frame(spark, rows)
