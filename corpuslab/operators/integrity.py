"""Checks of the inputs of reports: a row for each check, so that a report names all that is wrong at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _check(name: str, failures: DataFrame) -> DataFrame:
    """``(check, n_failures)`` of a table with a row for each failure."""
    return failures.agg(F.count("*").alias("n_failures")).select(F.lit(name).alias("check"), "n_failures")


def retrieval_inputs(records: DataFrame, summaries: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """Whether runs can be compared: ``records(system, qa_id, question_type)`` against ``summaries(system, n, top_k)``.

    Every named system has one summary and no other label occurs; counts are those of the records; ids are there, once in
    each system and the same in all; their types agree; all runs share one positive top-k.
    """
    known = F.col("system").isin(*systems)
    named = records.sparkSession.createDataFrame([(s,) for s in systems], "system string")  # a few names
    counts = records.groupBy("system").agg(F.count("*").alias("found"))
    per = summaries.join(F.broadcast(named), "system", "right").join(counts, "system", "left")
    ids = records.where(known & F.col("qa_id").isNotNull()).groupBy("qa_id").agg(F.count("*").alias("rows"), F.countDistinct("system").alias("systems"), F.countDistinct(F.coalesce("question_type", F.lit(""))).alias("types"))
    tops = summaries.where(known).agg(F.countDistinct("top_k").alias("k"), F.min("top_k").alias("least"))
    checks = (
        ("summary_for_each_system", summaries.groupBy("system").agg(F.count("*").alias("c")).join(F.broadcast(named), "system", "right").where("c is null or c <> 1")),
        ("records_are_labelled", records.where(~F.coalesce(known, F.lit(False)))),
        ("counts_agree", per.where("coalesce(n, -1) <> coalesce(found, 0)")),
        ("ids_are_there", records.where("qa_id is null or cast(qa_id as string) = ''")),
        ("ids_are_unique", ids.where("rows > systems")),
        ("ids_are_the_same", ids.where(F.col("systems") < len(systems))),
        ("types_agree", ids.where("types > 1")),
        ("one_top_k", tops.where("k <> 1 or least < 1")),
    )
    return _all(checks)


def judge_inputs(summaries: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """Whether judge runs can be compared: ``summaries(system, metric, context_budget)``: exactly the named systems, some dimension for each, one positive budget."""
    named = summaries.sparkSession.createDataFrame([(s,) for s in systems], "system string")
    budgets = summaries.agg(F.countDistinct("context_budget").alias("k"), F.min("context_budget").alias("least"))
    checks = (
        ("no_other_system", summaries.where(~F.coalesce(F.col("system").isin(*systems), F.lit(False)))),
        ("every_system", named.join(summaries, "system", "left_anti")),
        ("dimensions", F.broadcast(named).join(summaries.where("metric is not null"), "system", "left_anti")),
        ("one_budget", budgets.where("k <> 1 or least < 1")),
    )
    return _all(checks)


def _all(checks) -> DataFrame:
    out = None
    for name, failures in checks:
        one = _check(name, failures)
        out = one if out is None else out.unionByName(one)
    return out


def required(checks: DataFrame) -> None:
    """Raise with the names of all checks that failed; a handful of rows is read."""
    bad = [f"{r['check']} ({r['n_failures']})" for r in checks.where("n_failures > 0").orderBy("check").collect()]
    if bad:
        raise ValueError("inputs can't be compared: " + ", ".join(bad))


def page_range(pages: Column, page: Column) -> tuple[Column, Column]:
    """Ends of a chunk's pages: of a valid pair, else its one page, else -1."""
    valid = (F.size(pages) == 2) & pages[0].isNotNull() & pages[1].isNotNull()
    end = lambda i: F.coalesce(F.when(valid, pages[i]), page, F.lit(-1)).cast("int")
    return end(0), end(1)
