"""Judge runs: which dimensions apply, prompts, scores, the ledger, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.judging import FAILED, SKIP_ANSWER, SKIP_CONTEXT, SKIPPED, VALID, mock_score, parsed
from corpuslab.functions.text import empty, strip
from corpuslab.plans.config import DIMENSIONS

# What each dimension may see (reference answer, contexts, generated answer).
NEEDS = {"context_recall": (True, True, False), "context_precision": (True, True, False), "faithfulness": (False, True, True), "answer_relevancy": (False, False, True)}
KEY = ("qa_id", "system", "metric")


def dimensions(items: DataFrame, mode: str = "auto", chosen: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """A row for each item and dimension that its mode asks for: the two of contexts always, the others if answers are judged (``auto``: where there is one)."""
    answers = {"retrieval_only": F.lit(False), "generation": F.lit(True), "auto": strip(empty(F.col("answer"))) != ""}[mode]
    asked = F.array_compact(F.array(*[F.when(F.lit(not NEEDS[d][2]) | answers, F.lit(d)) for d in DIMENSIONS if d in chosen]))
    return items.select("*", F.explode(asked).alias("metric"))


def skipped(answer: Column, context: Column) -> Column:
    """The status of a dimension that lacks an input, or null."""
    needs = lambda i: F.col("metric").isin(*[d for d in DIMENSIONS if NEEDS[d][i]])
    blank = lambda c: strip(empty(c)) == ""
    return F.when(needs(2) & blank(answer), F.lit(SKIP_ANSWER)).when(needs(1) & blank(context), F.lit(SKIP_CONTEXT))


def prompt(question: Column, reference: Column, context: Column, answer: Column) -> Column:
    """Only the inputs of the dimension, each under its name."""
    needs = lambda i: F.col("metric").isin(*[d for d in DIMENSIONS if NEEDS[d][i]])
    part = lambda name, c: F.concat(F.lit(name + ": "), F.when(strip(empty(c)) == "", F.lit("(none)")).otherwise(c))
    return F.concat_ws("\n", F.concat(F.lit("Dimension: "), F.col("metric")), part("Question", question), F.when(needs(0), part("Reference", reference)), F.when(needs(1), part("Contexts", context)), F.when(needs(2), part("Answer", answer)))


def mock_scores(items: DataFrame, **kw) -> DataFrame:
    """Stand-in scores of items ``(qa_id, system, question, reference, context, answer)``."""
    rows = dimensions(items, **kw).withColumn("prompt", prompt(*[F.col(c) for c in ("question", "reference", "context", "answer")]))
    status = F.coalesce(skipped(F.col("answer"), F.col("context")), F.lit("scored"))
    return rows.select(*KEY, status.alias("judge_status"), F.when(status == "scored", mock_score(F.col("prompt"))).alias("score"), F.sha2("prompt", 256).alias("prompt_sha256"))


def parse_replies(replies: DataFrame, column: str = "raw_response", objects=None) -> DataFrame:
    """Replies with ``judge_status, score, rationale``."""
    found = parsed(F.col(column), objects) if objects else parsed(F.col(column))
    return replies.withColumn("__p", found).withColumns({"judge_status": F.col("__p.status"), "score": F.col("__p.score"), "rationale": F.col("__p.rationale")}).drop("__p")


def ledger(records: DataFrame, key: tuple[str, ...] = KEY, order: str = "line") -> DataFrame:
    """The latest record of each key that did not fail: an older success outlives a later failure."""
    good = records.where(~F.col("judge_status").isin(*FAILED))
    return good.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def pending(work: DataFrame, done: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return work.join(done.select(*key), list(key), "left_anti")


def merged(old: DataFrame, fresh: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Both ledgers, fresh records in place of old ones."""
    both = old.withColumn("__f", F.lit(0)).unionByName(fresh.withColumn("__f", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("__f")))).where("__r = 1").drop("__r", "__f")


def recover(records: DataFrame, objects=None) -> DataFrame:
    """Parse errors judged again from their stored replies; they become ``recovered`` or stay, all else is kept."""
    found = parsed(F.col("raw_response"), objects) if objects else parsed(F.col("raw_response"))
    rows = records.withColumn("__p", found)
    again = (F.col("judge_status") == "parse_error") & F.col("__p.status").isin(*VALID)
    return rows.withColumn("score", F.when(again, F.col("__p.score")).otherwise(F.col("score"))).withColumn("judge_status", F.when(again, F.lit("recovered")).otherwise(F.col("judge_status"))).drop("__p")


def _counts() -> list[Column]:
    status = F.col("judge_status")
    valid = status.isin(*VALID) & F.col("score").isNotNull()
    return [
        F.round(F.avg(F.when(valid, F.col("score"))), 6).alias("mean_score"), F.count_if(valid).alias("n_scored"), F.count_if(status.isin(*FAILED)).alias("n_errored"),
        F.count_if(status.isin(*SKIPPED)).alias("n_skipped"), F.count("*").alias("n_attempted"),
    ]


def summary(scores: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Means of valid scores (null if none) and counts; skips are no errors, attempts are all rows."""
    return scores.groupBy(*by).agg(*_counts(), F.countDistinct("qa_id").alias("n_questions"))


def by_field(scores: DataFrame, field: str) -> DataFrame:
    """The summary for each value of an audit field; booleans as text, missing, false-like and empty values as ``unknown``."""
    value = F.coalesce(F.nullif(F.col(field).cast("string"), F.lit("")), F.lit("unknown"))
    return scores.withColumn("value", value).groupBy("value", "metric").agg(*_counts())


def context_stats(scores: DataFrame) -> DataFrame:
    """Sizes and cuts of the contexts, one record of each question and system; retries over all records."""
    one = scores.where("context_token_count is not null").groupBy("system", "qa_id").agg(F.min_by(F.struct("context_token_count", "context_truncated"), "line").alias("c"))
    sizes = one.groupBy("system").agg(F.round(F.avg("c.context_token_count"), 6).alias("mean_tokens"), F.max("c.context_token_count").alias("max_tokens"), F.count_if("c.context_truncated").alias("n_truncated"), F.round(F.avg(F.col("c.context_truncated").cast("double")), 6).alias("truncation_rate"))
    tries = scores.groupBy("system").agg(F.sum("retries_used").alias("retries"))
    return tries.join(sizes, "system", "left")


def canonical(scores: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """Sorted by system, question and dimension, unknown ones last."""
    place = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    return scores.orderBy(place(systems, "system"), "qa_id", place(DIMENSIONS, "metric"), "metric")
