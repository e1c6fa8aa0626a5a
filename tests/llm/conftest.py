import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed: int = 5, n: int = 60) -> list[tuple]:
    """Invented texts: copies, near copies, nulls in every column, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij\u00e9") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 1, 2, 3, 40, 80, 150, 400]))
        if i % 7 == 3 and rows:
            t = rng.choice(rows)[1] or ""
        if i % 11 == 5:
            t += "\n" + "\n".join(["the same line stands here"] * 3) + "\ttail"
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", "\u00e4", None]), len(t)))
    rows += [(None, "no id stands here", "en", "a", None), (None, "no id stands here", None, None, None), (100, None, None, None, None), (101, "", "en", "a", 0)]
    rows += [(102, text(5000), "de", "b", None), rows[3], rows[3], (103, " \t\n\r\x0b\x0c", "en", "\U0001f600", 6)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns of clashing names beside them."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "fp", "judged", "row", "found", "size", "block", "node"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
