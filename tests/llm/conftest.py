import pytest

WORDS = "the cat sat on a mat and then it went home to sleep for the whole long day in its own small bed near the warm fire".split()


def text(n: int, seed: int = 0) -> str:
    """n words that hardly repeat in runs."""
    return " ".join(f"{WORDS[(i * 7 + seed) % len(WORDS)]}{(i * i + 31 * seed) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in each column, empty and long texts, repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, text(80), "en", "a", 5),
        (2, text(80), "en", "a", 5),
        (2, text(80), "en", "a", 5),
        (3, None, "en", None, None),
        (4, "", None, "b", 0),
        (5, " \t\n", "en", "b", 3),
        (6, text(6000, 3), "en", "b", None),
        (None, "no id at all here", "de", "b", 1),
        (7, "one", "de", "a", 3),
        (8, "é中\U0001f600 <|endoftext|> ▁ x", "de", "a", 3),
        (9, "12 34", "de", "a", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "1 AS k", "2 AS t", "3 AS rep", "4 AS key", "5 AS component", "6 AS _rank", "7 AS id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
