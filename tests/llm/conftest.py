import pytest

TEXTS = [
    (7, "The Cat sat.\nThe cat sat!", "en", "b", 25),
    (3, "the cat SAT.\nthe cat sat!", "en", "a", 25),
    (9, None, "en", None, 0),
    (1, "", "en", "b", 0),
    (4, "É é ÄÖ don't we'll <|endoftext|>, x<|startoftext|>y 12ab क़ab Ω \x85z a b İ ΣΣ", "de", "c", 60),
    (5, "word " * 6000, "en", "a", 30000),
    (7, "The Cat sat.\nThe cat sat!", "en", "b", 25),
    (None, "no id", "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(TEXTS, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in ("id", "size", "kept", "digest", "piece", "score", "key", "component_id")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
