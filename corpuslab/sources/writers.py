"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines with nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def flat(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns in the order given (missing ones null, others left out), nested values as JSON text."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for c in columns or df.columns:
        value = F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
        nested = isinstance(have.get(c), (ArrayType, MapType, StructType))
        out.append((F.to_json(value) if nested else value).alias(c))
    return df.select(*out)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV whose files begin with a byte-order mark, so that spreadsheets read them as UTF-8."""
    out = flat(df, columns)
    first, *rest = out.columns
    out.withColumnRenamed(first, "﻿" + first).select("﻿" + first, *rest).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both, those of ``new`` in place of old ones of the same key; empty vectors are skipped."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    if "values" in both.columns:
        both = both.where(F.size("values") > 0)
    latest = F.row_number().over(W.partitionBy(key).orderBy(F.desc("__new")))
    return both.withColumn("__r", latest).where("__r = 1").drop("__r", "__new")


def vector_metadata(chunks: DataFrame, limit: int = 12_000) -> DataFrame:
    """Flat metadata of chunks for a vector store."""
    from corpuslab.functions.text import clip, empty

    text = [empty(F.col(c)).alias(c) for c in ("lesson_number", "unit_title_ar", "lesson_title_ar", "lesson_title_en", "heading_ar")]
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) for c in ("diagram_image_urls", "standards")]
    return chunks.select(
        "chunk_id", "page_number", F.col("page_range")[0].alias("page_range_start"), F.col("page_range")[1].alias("page_range_end"),
        F.coalesce("unit_number", F.lit(0)).alias("unit_number"), *text, clip(F.col("content_text"), limit, "...").alias("content_text_ar"),
        F.coalesce(F.when(F.col("content_type") != "", F.col("content_type")), F.lit("other")).alias("content_type"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("has_diagram", "has_math")], *lists,
        F.transform(F.coalesce("problem_numbers", F.array().cast("array<int>")), lambda p: p.cast("string")).alias("problem_numbers"),
        F.lit("mathematics").alias("subject"), F.lit("ar").alias("language"), F.coalesce("extraction_confidence", F.lit(0.0)).alias("extraction_confidence"),
        F.coalesce(F.size("source_block_ids"), F.lit(0)).alias("source_block_count"),
    )
