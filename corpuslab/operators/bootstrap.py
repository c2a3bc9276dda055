"""Paired differences and their percentile bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.judging import VALID


def paired_differences(scores: DataFrame, a: str, b: str) -> DataFrame:
    """``(qa_id, metric, difference)`` of questions that both systems have a valid score for."""
    good = scores.where(F.col("judge_status").isin(*VALID) & F.col("score").isNotNull())
    one = lambda s, name: good.where(F.col("system") == s).select("qa_id", "metric", F.col("score").alias(name))
    return one(a, "x").join(one(b, "y"), ["qa_id", "metric"]).select("qa_id", "metric", (F.col("x") - F.col("y")).alias("difference"))


def bounds(resamples: int, confidence: float) -> tuple[int, int]:
    """Places of the limits among the sorted means, from 0."""
    low, high = int((1 - confidence) / 2 * resamples), int((1 + confidence) / 2 * resamples) - 1
    return max(0, min(low, resamples - 1)), max(0, min(high, resamples - 1))


def bootstrap(differences: DataFrame, resamples: int = 2000, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """``(metric, n, mean, lower, upper)``; draws are hashes of seed, resample and draw, so reruns and other engines agree.

    A metric's differences are broadcast as one array in order of questions (eight bytes
    each); resamples are dealt out as rows over the tasks.
    """
    base = differences.groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("qa_id", "difference"))), lambda x: x["difference"]).alias("d"))
    base = base.withColumn("n", F.size("d")).where("n > 0")
    low, high = bounds(resamples, confidence)
    spark = differences.sparkSession
    tries = spark.range(0, max(0, resamples), 1, max(1, min(resamples, spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("b"))
    rows = tries.crossJoin(F.broadcast(base))
    draw = lambda i: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("-", F.lit(str(seed)), F.col("b").cast("string"), i.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.col("n")).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda s, i: s + F.get("d", draw(i)))
    means = rows.select("metric", (total / F.col("n")).alias("m")).withColumn("r", F.row_number().over(W.partitionBy("metric").orderBy("m")) - 1)
    limits = means.groupBy("metric").agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("lower"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("upper"))
    plain = differences.groupBy("metric").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"))
    return plain.join(limits, "metric", "left").select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")])
