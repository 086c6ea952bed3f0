import random

import pytest

WORDS = "river stone light paper winter garden music silver letter window bridge forest candle mirror".split()


def prose(seed: int, n: int) -> str:
    """``n`` words that differ between seeds."""
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def documents(spark, rows):
    """Documents with columns besides the usual ones whose names operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), 7, "k") for i, t in rows]
    return spark.createDataFrame(
        full, "doc_id long, text string, lang string, source string, n_chars long, score int, key string"
    )
