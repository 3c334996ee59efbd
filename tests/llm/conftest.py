"""Small tables with every odd case: nulls, empty, blank and long texts,
ties, repeated rows, clashing extra columns, and no rows at all."""

import random

import pytest

DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              # names that operators use inside or return
              "n_words long, items string, score double, takes string, component_id long, kept string, key string, "
              "rep string, label string, _license string, lines string")


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    return [
        (0, base, "en", "a", 5), (1, base, "en", "a", 5), (1, base, "en", "a", 5),      # copy, repeated row
        (2, " ".join(near), "de", None, None),                                          # near copy
        (3, None, None, "b", 0), (4, "", "en", "b", 0), (5, " \n\t ", "en", "b", 3),
        (None, base, "en", "c", 1), (None, None, None, None, None),
        (6, words(2, 60_000, 9000), "fr", "c", 400_000),                                # very long
        (7, "one", "en", "d", 3), (8, "ONE", "en", "d", 3), (9, "two words", "en", "d", 9),
        (10, "日本語 ünï 😀 \x00 zero", "xx", "é", 10), (11, "x" * 5000, "en", "Z", 5000),
        (12, "Released under the MIT License.\nthen more", "en", "d", 40),
        (13, "you are such an idiot you idiot. trash", "en", "d", 40),
        (14, "### $$$ %%% &&&", "en", "d", 15),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, 7, "x", 0.5, "y", 3, "no", "k", "r", "l", "L", "z") for r in odd_texts()]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, None, None), (None, 1, 1), (5, 1, 1), (5, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
