"""Ranked-retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def question_scores(questions: DataFrame, hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """``first_rank``, ``reciprocal_rank`` and ``hit_at_k`` of each question; questions without gold score as misses."""
    relevant = gold.where("chunk_id is not null").select("qa_id", "chunk_id").distinct()
    first = hits.join(relevant, ["qa_id", "chunk_id"], "left_semi").groupBy("qa_id").agg(F.min("rank").alias("first_rank"))
    out = questions.join(first, "qa_id", "left").withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    return out.withColumns({f"hit_at_{k}": F.coalesce(F.col("first_rank") <= k, F.lit(False)) for k in ks})


def gold_recall(questions: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Covered targets over those that have a chunk: ``(qa_id, n_targets, n_covered, recall, unresolved)``; none gives 0."""
    found = gold.join(hits.select("qa_id", "chunk_id", F.lit(1).alias("hit")), ["qa_id", "chunk_id"], "left")
    per = found.groupBy("qa_id", "target_id").agg(F.count("chunk_id").alias("mapped"), F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    sums = per.groupBy("qa_id").agg(
        F.count_if(F.col("mapped") > 0).alias("n_targets"), F.sum(F.when(F.col("mapped") > 0, F.col("hit")).otherwise(0)).alias("n_covered"),
        F.array_sort(F.collect_list(F.when(F.col("mapped") == 0, F.col("target_id")))).alias("unresolved"),
    )
    out = questions.select("qa_id").join(sums, "qa_id", "left").fillna(0, ["n_targets", "n_covered"])
    out = out.withColumn("recall", F.when(F.col("n_targets") > 0, F.col("n_covered") / F.col("n_targets")).otherwise(F.lit(0.0)))
    return out.withColumn("unresolved", F.coalesce("unresolved", F.array().cast("array<string>")))


def summary(scores: DataFrame, ks: tuple[int, ...] = (1, 5), by: str | None = None) -> DataFrame:
    """Means over questions, of all (``overall``) and of each value of ``by``, in one pass; no questions give zeros."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    aggs = [F.count("*").alias("n_questions"), mean(F.col("reciprocal_rank")).alias("mrr"), *[mean(F.col(f"hit_at_{k}").cast("double")).alias(f"hit_at_{k}") for k in ks]]
    aggs += [mean(F.col("recall")).alias("recall")] if "recall" in scores.columns else []
    if by is None:
        return scores.agg(*aggs)
    return scores.rollup(by).agg(*aggs, F.grouping(by).alias("__all")).select(F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.coalesce(by, F.lit("unknown"))).alias(by), "n_questions", "mrr", *[f"hit_at_{k}" for k in ks], *(["recall"] if "recall" in scores.columns else []))


def rank_outcomes(scores: DataFrame, k: int = 5, by: str = "system") -> DataFrame:
    """Questions whose first relevant chunk is first, second to k-th, or not among k."""
    r = F.col("first_rank")
    return scores.groupBy(by).agg(F.count_if(r == 1).alias("rank_1"), F.count_if((r > 1) & (r <= k)).alias("rank_2_to_k"), F.count_if(r.isNull() | (r > k)).alias("missed"))


def misses(scores: DataFrame, k: int = 5) -> DataFrame:
    return scores.where(~F.col(f"hit_at_{k}"))


def paired(scores: DataFrame, systems: tuple[str, ...], column: str = "reciprocal_rank") -> DataFrame:
    """A row for each question, a column for each system."""
    return scores.groupBy("qa_id").pivot("system", list(systems)).agg(F.first(column))


def deltas(summaries: DataFrame, a: str, b: str, keys: tuple[str, ...] = ("question_type",), metrics: tuple[str, ...] = ("mrr",)) -> DataFrame:
    """``(keys, metric, a, b, difference)`` of two systems' summaries, metrics as rows."""
    long = summaries.unpivot(["system", *keys], list(metrics), "metric", "value")
    left, right = long.where(F.col("system") == a), long.where(F.col("system") == b)
    both = left.select(*keys, "metric", F.col("value").alias("a")).join(right.select(*keys, "metric", F.col("value").alias("b")), [*keys, "metric"])
    return both.withColumn("difference", F.round(F.col("a") - F.col("b"), 6))


def full_summary(scores: DataFrame, types: tuple[str, ...], ks: tuple[int, ...] = (1, 5), by: str = "question_type") -> DataFrame:
    """All of a run's figures, over everything and by type: also the contexts' tokens and how many questions have gold.

    ``scores`` has ``n_targets`` and ``token_count`` beside the ranks. ``position`` orders the rows: all questions first, then ``types`` in
    their order, then types that nobody expected, by name. No questions give a row of zeros.
    """
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    with_gold = F.count_if(F.coalesce("n_targets", F.lit(0)) > 0)
    out = scores.withColumn("__t", F.coalesce(by, F.lit(""))).rollup("__t").agg(
        F.count("*").alias("n_questions"), mean(F.col("reciprocal_rank")).alias("mrr"), mean(F.col("recall")).alias("recall"), *[mean(F.col(f"hit_at_{k}").cast("double")).alias(f"hit_at_{k}") for k in ks],
        mean(F.coalesce("token_count", F.lit(0))).alias("context_tokens_mean"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("context_tokens"),
        with_gold.alias("with_gold"), (F.count("*") - with_gold).alias("without_gold"), F.grouping("__t").alias("__all"),
    )
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("__t"))
    position = F.when(F.col("__all") == 1, 0).when(place > 0, place).otherwise(len(types) + 1).cast("int")
    return out.withColumns({"position": position, by: F.when(F.col("__all") == 1, F.lit("overall")).otherwise(F.col("__t"))}).drop("__t", "__all")


def unexpected(scores: DataFrame, types: tuple[str, ...], by: str = "question_type") -> DataFrame:
    """Values that are not among the expected ones, with their counts."""
    return scores.where(~F.coalesce(F.col(by).isin(*types), F.lit(False))).groupBy(by).agg(F.count("*").alias("n"))
