import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the and of to in is it that was for on are with as be at this by from or an not have which but".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * 7 + i * i * 3 + seed * 11 + i // 5) % len(WORDS)] + str((i * (seed + 3)) % 17) for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, and a long text."""
    return [
        (1, "Plain words that are written here, over and over, in no odd way at all, by one who likes plain words and nothing else.", "en", "a", 1),
        (1, "Plain words that are written here, over and over, in no odd way at all, by one who likes plain words and nothing else.", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "de", "b", 4),
        (None, "No id, but a mail: someone@example.com and +1 (555) 123-4567.", "en", "b", 60),
        (5, "x" * 200_000, "en", "a", 200_000),
        (6, "line of words here\n" * 4000, "fr", None, 76_000),
        (7, "ÄÖÜ ß 漢字 😀 🇩🇪 é \u0000 ▁ end", "de", "b", 20),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
