import random

import pytest
from pyspark.sql import types as T

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(draw, n, words=None):
    words = words or ["".join(draw.choice(LETTERS) for _ in range(draw.randint(2, 9))) for _ in range(300)]
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every odd case: null and empty texts, a very long one, copies, near copies, repeated rows, null ids."""
    draw = random.Random(4)
    base = [prose(draw, draw.randint(30, 160)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        words = t.split(" ")
        rows.append((100 + i, t))
        rows.append((200 + i, " ".join([*words[:-2], "changed", "ending"])))
        rows.append((300 + i, " ".join(w if j % 9 else "x" + w for j, w in enumerate(words))))
    rows += [
        (400, None), (401, ""), (402, " \t\n "), (403, "One two"), (404, "one TWO"), (405, prose(draw, 30_000)), (5, base[5]), (5, base[5]),
        (None, base[6]), (None, None), (406, "Ünïcode  wörds\tand \r\n odd\x0bspace <|endoftext|> it's 日本語 😀 12 x"), (407, "same " * 120),
        (408, "\n".join(["the very same line of text here"] * 40)), (409, "*** $$$ ### " * 60),
    ]
    rows = [(i, t, "en" if n % 3 else None, float(n), f"s{n}") for n, (i, t) in enumerate(rows)]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("score", T.DoubleType()), T.StructField("row", T.StringType())]
    )
    return spark.createDataFrame(rows, schema), rows


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 0 if i % 4 == 0 else 1, 1 if i % 5 == 0 else 0) for i in range(60)] + [(3, None, None), (None, 1, 1), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(spark, corpus):
    return spark.createDataFrame([], corpus[0].schema)
