import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def made_documents(n=160, seed=3):
    """Made-up documents: unlike ones, copies, near copies, shared passages, empties, nulls, one long."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "to", "Re", "mi", "é", "nu", "zo", "9"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage = prose(40)
    texts = [prose(rng.choice([1, 3, 5, 12, 30, 90])) for _ in range(n)]
    for _ in range(n // 4):
        i, j = rng.randrange(n), rng.randrange(n)
        texts[i] = texts[j]
    base = prose(120).split(" ")
    for k in range(n // 8):
        other = list(base)
        for _ in range(rng.randint(0, 4)):
            other[rng.randrange(len(other))] = word()
        texts[k * 3] = " ".join(other)
    for k in range(n // 10):
        texts[k * 7 + 1] = prose(10) + " " + passage + "\n" + prose(8)
    texts[2], texts[5], texts[8], texts[11] = "", None, " \t\n ", "...!!"
    texts[14] = prose(9000)
    return [(i * 3 - 7, t, "xx" if i % 3 else "yy", f"s{i % 4}" if i % 5 else None, len(t) if t else 0) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    from fieldlens.llm.common import small_batches
    from fieldlens.shipping import ship

    ship(spark)
    small_batches(spark, 50)
    return spark.createDataFrame(made_documents(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_tables():
    p = Path("/root/testdata/sf0.001")
    if not p.exists():
        pytest.skip("no driver tables here")
    return str(p)
