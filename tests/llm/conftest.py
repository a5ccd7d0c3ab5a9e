import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, mix int, fp long, cls string"

WORDS = ["the", "of", "and", "river", "stone", "cloud", "über", "naïve", "Ünder", "maybe", "path", "window", "glass", "light", "seven",
         "north", "south", "walks", "sings", "paper", "ink", "tree.", "house,", "I'll", "don't", "x1", "42", "###", "é", "END"]


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small rows with nulls in any column, empty and long texts, copies, repeated rows, shared passages."""
    rng = random.Random(5)
    shared = words(rng, 30)
    out = []
    for i in range(120):
        text = words(rng, rng.choice([1, 2, 5, 40, 60, 90, 200]))
        if i % 5 == 0:
            text = text + "\n" + shared + " " + words(rng, 4)
        if i % 7 == 0:
            text = out[i // 2][1] if i else text
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "z", "é", None]), len(text or ""), "s", i, -i, None))
    out += [(200, None, "en", "a", None, None, None, None, None), (201, "", None, None, 0, None, None, None, None), (202, " \t\n ", "en", "b", 4, None, None, None, None),
            (203, words(rng, 9000), "en", "a", 0, None, None, None, None), (204, "one", "en", "c", 3, None, None, None, None), (205, "one two", "en", "c", 7, None, None, None, None),
            (None, words(rng, 70), "en", "a", 9, None, None, None, None), (3, out[3][1], "en", "a", 9, None, None, None, None), (3, out[3][1], "en", "a", 9, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
