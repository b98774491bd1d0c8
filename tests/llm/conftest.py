import pytest

TEXTS = [
    "The quick  brown fox\n jumps over the lazy dog.",
    "",
    None,
    "ÄÖÜ straße naïve café ñandú — “quoted” 12345 x_y",
    "a <|endoftext|> b<|startoftext|>c it's we'll I'D",
    "word " * 6000,
    "x" * 5000,
    "odd\x1cspace\x1fhere\x85and there wide é ́alone İI",
    "The quick  brown fox\n jumps over the lazy dog.",
    "   \n\t ",
]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, a null id, a clashing extra column."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (None, "no id", "en", "s", 1)]
    return frame(spark, rows).withColumnRenamed("n_chars", "start")


@pytest.fixture
def no_docs(spark):
    return frame(spark, [])
