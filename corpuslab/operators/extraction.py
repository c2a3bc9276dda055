"""Model replies as page rows: parsed, checked against the schema, rejected with a reason, nothing dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.sources.readers import _struct
from corpuslab.sources.schemas import PAGE


def unfenced(reply: Column) -> Column:
    """A reply without a fence around all of it."""
    return F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), r"(?s)^```(?:json)?\s*|\s*```$", "")


def parse_pages(replies: DataFrame) -> DataFrame:
    """``replies(book, page_number, raw_response)`` with ``page`` or a ``reason``.

    A reply must be a JSON object without an ``error`` key that fits the page schema;
    the page number is stamped from the request, whatever the reply says.
    """
    schema = f"struct<{_struct(PAGE)}, _bad: string>"
    text = unfenced(F.col("raw_response"))
    rows = replies.withColumn("__v", F.try_parse_json(text)).withColumn("__p", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    kind = F.schema_of_variant("__v")
    reason = (
        F.when(F.col("__v").isNull(), F.lit("no JSON"))
        .when(~F.startswith(kind, F.lit("OBJECT")), F.lit("no object"))
        .when(F.try_variant_get("__v", "$.error", "string").isNotNull(), F.concat(F.lit("error: "), F.try_variant_get("__v", "$.error", "string")))
        .when(F.col("__p").isNull() | F.col("__p._bad").isNotNull(), F.lit("schema violation"))
    )
    page = F.col("__p").dropFields("_bad").withField("page_number", F.col("page_number").cast("int")).withField("book", F.col("book"))
    return rows.withColumn("reason", reason).withColumn("page", F.when(F.col("reason").isNull(), page)).drop("__v", "__p")


def pages(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").select("page.*")


def failures(parsed: DataFrame) -> DataFrame:
    """The log of rejected pages."""
    return parsed.where("reason is not null").select("book", "page_number", "reason")


def box_failures(diagrams: DataFrame) -> DataFrame:
    """Diagrams whose box isn't four numbers, which boxes leave out."""
    return diagrams.where("box_2d is null or size(box_2d) <> 4 or exists(box_2d, x -> x is null)").select("book", "page_number", "block_index", F.lit("box_2d is not four numbers").alias("reason"))


def pending(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a stage still has to do: finished keys are not repeated."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
