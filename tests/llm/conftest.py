import pytest

LONG = " ".join(f"word{i % 977} filler{i}" for i in range(20_000))
TEXTS = [None, "", "   \n\t ", "one", "Same text here, twice over and over.", "Same text here, twice over and over.", "Élan ünï – 日本語\nzwei", LONG, LONG + " end", "<|endoftext|> \x00 \x1c odd"]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a null id and extra columns with clashing names."""
    rows = [(i, t, "en", "s", 1, 2, 0.5, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, kept string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
