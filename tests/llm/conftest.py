import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, short, long, repeated and nearly equal texts."""
    base = passage(1, 120)
    shared = passage(2, 30)
    out = [(1, base, "a"), (2, base, "a"), (3, base + " tail", None), (4, base.replace("w1 ", "X ", 1), "b"), (5, None, "b"), (6, "", "c"), (7, " \t\n", "c"), (8, "one two", "a"), (9, "ONE two", "a")]
    out += [(10, passage(3, 60) + " " + shared + " " + passage(4, 60), "d"), (11, shared + " " + passage(5, 80), "d"), (12, "x" * 300, "a"), (13, "yy" + "x" * 120, "a"), (14, passage(6, 6000) + " é ñ", "b"), (15, base.upper(), None)]
    out += [(20 + i, base + f" {passage(50 + i, 6)}", "a") for i in range(12)]
    out += [(40, "same", "a"), (40, "same", "a"), (None, "same", "a"), (41, "same", "b")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("digest", "salt", "n", "t", "rank", "number", "size", "block", "part", "order", "label", "doc", "variant", "prefix", "lines"):
        df = df.withColumn(name, F.lit("extra"))
    return df.repartition(3)
