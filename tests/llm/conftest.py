"""Documents with every odd case that operators must take."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.IntegerType()),
        T.StructField("print", T.StringType()),
    ]
)


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None if k % 3 else "en", "s", None, k, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "déjà", "ß", "delta", "x" * 40, "1", "é e", "zeta,"]
    texts = [None, "", " ", "\n", "\n\n\n", "\t \x0b\x0c\r\n a \r", "a", "A", "word", "word word", " ", "x" * 30_000]
    texts += ["common line\n" + " ".join(rng.choices(words, k=rng.randint(1, 60))) + "\n COMMON line\t" for _ in range(25)]
    texts += [" ".join(rng.choices(words, k=k)) for k in (3, 4, 5, 400, 3000)] * 2
    texts += ["\n".join(rng.choices(["l1", "L1 ", "l2", "", "l3"], k=9)) for _ in range(12)]
    return texts
