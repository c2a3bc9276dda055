import time

import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def documents(spark):
    """Odd documents: nulls everywhere, empty, blank and long texts, ties, repeated rows, columns with clashing names."""
    words = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat and looked at the dog for a while", "en", "a"), (2, "the cat sat on the mat and looked at the dog for a while", "en", "a"), (2, "the cat sat on the mat and looked at the dog for a while", "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (5, " \t\n", "fr", "b"), (6, words, "en", None), (7, words + " end", "en", "a"), (None, "le chat est sur la table et regarde le chien", "fr", "a"), (None, None, None, None),
        (8, "ÀÉ 123 !!", "fr", "é"), (9, "12345 !!", None, "b"), (10, "one", "en", "b"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("x") for c in ("id", "key", "root", "n", "h", "size", "place", "spans")})


@pytest.fixture()
def shuffled(spark):
    """Bytes that a call shuffles where no table is small enough to be broadcast unasked."""

    sc, name = spark.sparkContext._jsc.sc(), "spark.sql.autoBroadcastJoinThreshold"

    def total():
        time.sleep(0.3)  # the sums of executors are brought up to date at most every 0.1 s, as a task ends
        spark.range(1).count()
        sc.listenerBus().waitUntilEmpty(30_000)
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.length()))

    def measure(call):
        before, least = total(), spark.conf.get(name)
        spark.conf.set(name, "-1")
        try:
            call()
        finally:
            spark.conf.set(name, least)
        return total() - before

    return measure
