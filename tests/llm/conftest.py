import pytest

LONG = " ".join(f"w{i % 977}q" for i in range(30_000))
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "x"), (1, "alpha beta gamma delta epsilon zeta", "x"), (2, None, None), (3, "", "en"), (None, "no id here at all", "en"), (None, None, None),
    (4, " \t\n\r ", "en"), (5, LONG, "en"), (6, LONG, "fr"), (7, "é" * 5000, "fr"), (8, "one\ntwo\n\none\n", "de"), (9, "1234 !!", "de"), (10, "日本語 текст mixed", "en"), (11, "a\x00b <|endoftext|> \x1c c", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, lang, f"s{k}", k, k, "u", 1, 2) for k, (i, t, lang) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tag int, _gone string, node int, key int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
