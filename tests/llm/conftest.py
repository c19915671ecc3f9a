import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, component long, score double, ids string, n_deleted string, "
    "_id long, _fp string, _runs int, _gone string, _key int, _c string, Lossless string, `a.b` int, _salt int, _n int, _u int, _r int"
)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    rnd = random.Random(1)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(30_000))
    line = "one two three four five six seven eight nine ten.\n"
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "fr", None),
        (4, " \t\n\x0b\x0c\r ", None, "b"),
        (None, "no id here at all 12 a@b.cd +1 (555) 123-4567", "en", "b"),
        (None, None, None, None),
        (5, long, "en", "a"),
        (6, line * 40, "en", "a"),
        (6, line * 40, "en", "a"),
        (7, "Ünïcödé ▁ ẞ 漢字 \x00 \x1f x y 😀", "de", "c"),
        (8, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"),
        (9, "x" * 50_000, "en", "a"),
        (10, "1" * 3_000 + "@" * 50, None, "a"),
        (6, "another text under a known id", "en", "d"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 5, 0.5, "x", "y", 1, "f", 2, "g", 3, "c", "l", 4, 5, 6, 7, 8) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
