import pytest

ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, " \t\n ", "en", None, 3),
    (4, "one two", "en", "s", 7),
    (4, "one two", "en", "s", 7),
    (5, "Größe ñandú café 你好 " * 30, "de", "s", 1),
    (None, "no id here at all", None, None, None),
    (6, "word " * 40_000, "en", "s", 200_000),
    (7, "a" * 50_000, "fr", "s", 50_000),
]
#: Columns that clash with names the operators use.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, piece int, key1 string, digest string, quality string, score string, length string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(*r, None, None, 1, "k", "d", "q", "s", "l") for r in ODD], CLASH)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def files():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
