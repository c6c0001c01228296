import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"), (2, "The quick brown fox jumps over the lazy dog again and again"),
    (3, None), (4, ""), (5, " \t\n"), (6, "12 34 --"), (7, "naïve ▁x  日本 😀\r\nend"), (8, "word " * 5000), (9, "a" * 20000), (None, "no id here"), (1, "an id again"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, t string, fp long, rep long, h boolean, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, long and repeated rows, and columns whose names operators use inside."""
    rows = [(i, t, "en" if n % 2 else None, "s", len(t or ""), 1, "t", 2, 3, True, 0.5) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clean(spark):
    """400 texts of two invented languages, a few of them toxic."""
    import random

    rng = random.Random(3)
    words = {"aa": ["the", "thing", "over", "water", "stone", "with", "light"], "bb": ["der", "auch", "nicht", "schön", "über", "wasser", "licht"]}
    bad = {"aa": ["idiotic", "idiotical"], "bb": ["dummkopf", "dummheit"]}
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        text = [rng.choice(words[lang]) + rng.choice(["", "er", "ing", "en"]) for _ in range(30)]
        toxic = i % 8 < 2
        if toxic:
            text[rng.randrange(30)] = rng.choice(bad[lang])
        rows.append((i, " ".join(text), lang, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def column(name):
    return F.col(name)
