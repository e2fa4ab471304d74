import pytest

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"),
        (2, None, "en", "a"),
        (3, "", "de", None),
        (4, " \t\n ", None, "b"),
        (5, LONG, "en", "b"),
        (6, LONG, "fr", None),
        (7, "12 345 !!", "es", "b"),
        (None, "no id here but a text of some words that goes on", None, None),
        (None, None, None, None),
        (8, "a b c\x0b\x0cd", "en", "c"),
        (8, "another text under the same id", "en", "c"),
    ]
    return spark.createDataFrame(
        [(d, t, la, s, 0, 0, "x", 1, 1, 1, 1) for d, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, key string, row int, rank int, fp int, start int"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
