"""The driver's tables in the shape of the pipeline's: sources as books, documents as pages, lines as blocks.

Numbers, titles, types and flags that the tables lack are fixed functions of the page and block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.text import ws_tokens
from corpuslab.plans.config import CONTENT_TYPES, DIMENSIONS, QUESTION_TYPES
from corpuslab.sources.schemas import DIAGRAM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(book, page_number, unit_number, unit_title_ar, lesson_number, lesson_title_ar, text)``; every seventh page has a unit, page 0 the unit 0, which is none."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("book"), d.cast("int").alias("page_number"), F.when(d % 7 == 0, F.floor(d / 7).cast("int")).alias("unit_number"),
        F.when(d % 14 == 0, F.concat(F.lit("Unit "), F.floor(d / 7).cast("string"))).when(d % 11 == 0, F.lit("stray")).alias("unit_title_ar"),
        F.concat("lang", F.lit("."), (F.floor(d / 40) % 50).cast("string")).alias("lesson_number"), F.concat(F.lit("Lesson "), "lang").alias("lesson_title_ar"), "text",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line with text."""
    rows = pages(spark, sf_dir).select("*", F.posexplode(F.split("text", "\n")).alias("block_index", "text_ar")).drop("text").where(F.trim("text_ar") != "")
    k = F.col("page_number") + F.col("block_index")
    flag = F.col("page_number") * 3 + F.col("block_index")
    numbers = F.slice(F.regexp_extract_all("text_ar", F.lit("([0-9]+)"), 1), 1, 2)
    diagram = F.struct(F.lit(0).alias("diagram_index"), F.array(*[F.pmod(k * m, F.lit(1100)).cast("double") for m in (7, 11, 13, 17)]).alias("box_2d"), F.when(k % 6 == 0, F.concat(F.lit("figure "), k.cast("string"))).otherwise(F.lit("")).alias("description"), F.array(F.lit("A"), k.cast("string")).alias("labels"))
    none = F.array().cast("array<string>")
    named = F.struct(none.alias("theorems"), F.when(k % 9 == 0, F.array(F.concat(F.lit("term "), k.cast("string")))).otherwise(none).alias("definitions"), F.array().cast("array<struct<term_ar: string, term_en: string>>").alias("vocabulary"), F.when(k % 10 == 0, F.array(F.concat(F.lit("S"), (k % 3).cast("string")))).otherwise(none).alias("standards"))
    return rows.select(
        "*", F.lit(None).cast("string").alias("lesson_title_en"), F.lit(None).cast("string").alias("standard"), _pick(CONTENT_TYPES, k).alias("content_type"), F.when(k % 3 == 0, F.concat(F.lit("H"), (F.col("page_number") % 4).cast("string"))).alias("heading_ar"),
        F.array(k).alias("problem_numbers"), numbers.alias("math_expressions"), F.when(k % 4 == 0, F.array(diagram)).otherwise(F.array().cast(f"array<{DIAGRAM}>")).alias("diagrams"),
        named.alias("named_elements"), (flag % 4 == 0).alias("continues_to_next_page"), (flag % 4 == 1).alias("continued_from_prev_page"),
    )


def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as segments of their book's token stream."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("stream_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("int").alias("page_number"), ws_tokens(F.col("text")).alias("tokens"))


def block_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as segments, with their ids."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("stream_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    return rows.select("stream_id", (F.col("doc_id") * (1 << 20) + F.col("i")).alias("seq"), F.col("doc_id").cast("int").alias("page_number"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("-b"), F.col("i").cast("string")).alias("block_id"), ws_tokens(F.col("line")).alias("tokens"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, types in turn."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_id"), "text", _pick(QUESTION_TYPES, F.col("item_id")).alias("question_type"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def containment_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole item, ``(qa_id, target_id, chunk_id)``, items without any kept.

    Runs of six words are the join key, an item's second to seventh word against all of
    a document's: only pairs that share one are compared. The key lies inside the item,
    so words cut at its edges do no harm; items need nine words or more.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(c, "\n", " "), " "), lambda x: x != "")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_id"), F.col("text").alias("q"), F.array_join(F.slice(words(F.col("text")), 2, 6), " ").alias("key"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("t"), words(F.col("text")).alias("w"))
    runs = d.select("chunk_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 5)), lambda i: F.array_join(F.slice("w", i, 6), " ")))).alias("key"))
    near = runs.join(q.select("qa_id", "key"), "key").select("qa_id", "chunk_id").distinct()
    found = near.join(d.select("chunk_id", "t"), "chunk_id").join(q.select("qa_id", "q"), "qa_id").where(F.contains("t", "q")).select("qa_id", "chunk_id")
    return q.select("qa_id").join(found, "qa_id", "left").select("qa_id", F.col("qa_id").cast("string").alias("target_id"), "chunk_id")


def judge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as judge records: lines in order, statuses in turn, two systems, repeated keys."""
    rows = table(spark, sf_dir, "conversations")
    line = F.col("conv_id") * 1000 + F.col("turn")
    k = F.col("conv_id") + F.col("turn")
    statuses = ("scored", "recovered", "parse_error", "api_error", "invalid_score", "skipped_no_context", "scored")
    status = _pick(statuses, k * 5)
    good = status.isin("scored", "recovered")
    return rows.select(
        (F.col("conv_id") % 50).alias("qa_id"), _pick(("proposed", "b2"), F.col("turn")).alias("system"), _pick(DIMENSIONS, F.col("conv_id")).alias("metric"), line.alias("line"), status.alias("judge_status"),
        F.when(good, (F.length("text") % 101) / 100).alias("score"), (k % 3).alias("retries_used"), "role", (F.length("text") * 1).cast("long").alias("context_token_count"), (k % 4 == 0).alias("context_truncated"),
        F.when(k % 5 == 0, F.concat(F.lit('{"score": 0.'), (k % 10).cast("string"), F.lit(', "rationale": "ok"}'))).when(k % 5 == 1, F.lit('"score": 0.7, cut')).when(k % 5 == 2, F.lit('{"score": 7}')).when(k % 5 == 3, F.lit("no reply")).otherwise(F.lit('```json\n{"score": "0.25"}\n```')).alias("raw_response"),
    )
