from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int, class string, part int, score string, `__kept` int"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["stone", "river", "of", "the", "lantern", "grey", "winter", "a", "north", "hollow", "it's", "we'll", "Über", "naïve", "12", "x_y"]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), "k", 1, "c", 2, "no", 5)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, near copies and clashing names."""
    rng = random.Random(7)
    base = words(rng, 120)
    rows = [row(i, words(rng, rng.randint(1, 150)), rng.choice(["en", "de", None])) for i in range(40, 60)]
    rows += [row(1, base), row(2, base), row(3, base + " tail"), row(4, "Zero " + base), row(5, None), row(6, ""), row(7, " \n\t "), row(8, "one"), row(9, "one")]
    rows += [row(10, words(rng, 20000)), row(None, base), row(None, None), row(11, "same row"), row(11, "same row"), row(12, "ﬀ é 中文 🙂\nline\nline\n\n it's"), row(13, base[:300])]
    rows += [(14, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
