import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun", "vo", "ble", "ing", "da", "ru") for b in ("n", "st", "ra", "lim", "o", "er", "ti", "wu", "x", "pe")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.fixture()
def text_of():
    rng = random.Random(5)
    return lambda n: "\n".join(sentence(rng, min(12, n)) for _ in range(max(1, n // 12)))


@pytest.fixture()
def odd_docs(spark, text_of):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use inside."""
    long = text_of(60_000)
    rows = [(1, "a b c", "en", "s1", 5), (1, "a b c", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", None, 0), (None, "x y", None, "s2", 3), (4, long, "de", "s1", len(long)), (5, " \n\t ", None, "s2", 4)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({"score": F.lit(9.0), "h": F.lit("h"), "label": F.lit(1), "p": F.lit(0.5), "rep": F.lit(7), "copies": F.lit(8), "size": F.lit("z"), "key": F.lit(1)})


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
