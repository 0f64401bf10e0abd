import random

import pytest

SYLLABLES = ["an", "ber", "co", "den", "el", "fi", "gra", "hu", "in", "jo"]


def words(draw: random.Random, n: int) -> list[str]:
    return ["".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Rows of every odd kind: nulls in each column, empty, blank and long texts, repeats, ties, extra columns."""
    long = " ".join(words(random.Random(1), 60_000)) + "\n" + "x" * 200_000
    same = "one two three four five six seven\nline b\nline c\nline d"
    rows = [
        (1, same, "en", "a", 1, "x", 1), (2, same, None, None, None, "x", 1), (2, same, None, None, None, "x", 1), (3, None, "en", "a", 1, "y", 2), (4, "", "fr", "a", 1, "y", 2),
        (5, " \t\n ", "de", "b", 1, None, None), (6, long, "en", "b", 1, "z", 3), (None, "text without any id at all here", "en", "b", 1, "z", 3), (7, "héllo wörld ß 漢字 😀\x00\x1c\x85", "de", "b", 1, "z", 3), (8, "short", "en", "b", 1, "z", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept long").coalesce(2)
