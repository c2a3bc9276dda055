"""Scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpuslab.sources import schemas


def in_range(page: F.Column, start: int, end: int | None) -> F.Column:
    """Inclusive; keys that are not numbers are outside."""
    page = page.try_cast("int")
    inside = page >= start if end is None else page.between(start, end)
    return F.coalesce(inside, F.lit(False))


def pages(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Page extractions, one JSON object a file; unreadable files and other values are left out."""
    raw = spark.read.schema(schemas.PAGE + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull() & in_range(F.col("page_number"), start, end)).drop("_bad")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise, a missing path is empty."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON list; any other top level raises."""
    text = spark.read.text(path, wholetext=True)
    checked = text.select(F.when(F.col("value").rlike(r"(?s)^\s*\["), F.col("value")).otherwise(F.raise_error(F.lit("the file holds no JSON list"))).alias("value"))
    fields = ", ".join(schema.split("\n"))
    return checked.select(F.explode(F.from_json("value", f"array<struct<{_struct(fields)}>>")).alias("x")).select("x.*")


def _struct(ddl: str) -> str:
    """``a int, b string`` as ``a: int, b: string``, on the top level only."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Texts of pages from files ``page_N.txt``."""
    text = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return text.select(F.regexp_extract(name, r"(\d+)\.txt$", 1).try_cast("int").alias("page_number"), F.col("value").alias("text"))


def blocks(page_rows: DataFrame) -> DataFrame:
    """A row for each block of each page; pages without blocks give none."""
    keep = [c for c in page_rows.columns if c != "content_blocks"]
    return page_rows.select(*keep, F.explode("content_blocks").alias("b")).select(*keep, "b.*")


def diagrams(block_rows: DataFrame) -> DataFrame:
    return block_rows.select("book", "page_number", "block_index", F.explode("diagrams").alias("d")).select("book", "page_number", "block_index", "d.*")


def expressions(block_rows: DataFrame) -> DataFrame:
    return block_rows.select("book", "page_number", "block_index", F.posexplode("math_expressions").alias("position", "expression"))


def cer_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CER_SHEET).option("header", True).option("multiLine", True).csv(path)


def zipped(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Chunks with their texts by ``ordinal``; a missing partner or another ``chunk_id`` raises when the rows are read."""
    both = chunks.join(texts.withColumnRenamed("chunk_id", "__id"), "ordinal", "full")
    same = F.col("chunk_id").eqNullSafe(F.col("__id")) & F.col("chunk_id").isNotNull()
    return both.withColumn("chunk_id", F.when(same, F.col("chunk_id")).otherwise(F.raise_error(F.lit("chunks and texts do not match")))).drop("__id")
