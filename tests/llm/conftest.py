import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, size string, rest int, row int, words int, copies int, block int, h int"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text[, source]); its other columns have names that operators use inside."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "k", 1, "z", 1, 1, 1, 1, 1, 1) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


#: Null and odd values in every column, repeated rows, ties.
ODD = [
    (1, None, "b"),
    (2, "", None),
    (None, "Some words here and there", "a"),
    (None, "Some words here and there", "a"),
    (3, "one", "a"),
    (3, "one", "a"),
    (4, "  \n\t ", ""),
    (5, "one two three four " * 3000, "c"),
    (6, "naïve café 日本語 İ <|endoftext|> don't  stop\n\n's", "a"),
    (7, "x" * 5000, "b"),
    (-8, "One", None),
]


@pytest.fixture
def odd(documents):
    return documents(*ODD)


@pytest.fixture
def none(documents):
    return documents(ODD[0]).limit(0)
