"""Fixed sliding token windows with provenance.

Tokens are never exploded: a segment (a page's or a block's tokens) gets its
offset in the stream from sums of segment sizes, and hands each window that it
touches one slice. A window's segments are then joined in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Segments whose sizes are summed before the offsets are.
STRIP = 1024


def with_offsets(segments: DataFrame) -> DataFrame:
    """``segments(stream_id, seq, tokens, ...)`` with ``n`` and ``offset``.

    ``seq`` is a unique order in the stream. Sums of strips carry the offsets, so a long
    stream is not one task.
    """
    sized = segments.withColumn("n", F.size("tokens").cast("long")).withColumn("__strip", F.floor(F.col("seq") / STRIP))
    strips = sized.groupBy("stream_id", "__strip").agg(F.sum("n").alias("__n"))
    before = W.partitionBy("stream_id").orderBy("__strip").rowsBetween(W.unboundedPreceding, -1)
    strips = strips.select("stream_id", "__strip", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"), F.sum("__n").over(W.partitionBy("stream_id")).alias("stream_tokens"))
    inside = W.partitionBy("stream_id", "__strip").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return sized.join(strips, ["stream_id", "__strip"]).withColumn("offset", F.col("__off") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("__strip", "__off")


def slices(segments: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """A row for each window that a segment touches: ``window``, ``part`` (its tokens there) and ``first`` (their position).

    Windows start every ``max(1, size - overlap)`` tokens; there are none for an empty
    stream, else one and as many more as the rest needs.
    """
    stride = max(1, size - overlap)
    rows = with_offsets(segments).where("n > 0")
    windows = 1 + F.ceil(F.greatest(F.lit(0), F.col("stream_tokens") - size) / stride)
    low = F.greatest(F.lit(0), F.ceil((F.col("offset") - size + 1) / stride))
    high = F.least(windows - 1, F.floor((F.col("offset") + F.col("n") - 1) / stride))
    rows = rows.where(low <= high).withColumn("window", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    start = F.greatest(F.col("offset"), F.col("window") * stride)
    end = F.least(F.col("offset") + F.col("n"), F.col("window") * stride + size)
    rows = rows.withColumn("first", start).withColumn("__take", (end - start).cast("int")).where("__take > 0")
    return rows.withColumn("part", F.slice("tokens", (F.col("first") - F.col("offset") + 1).cast("int"), F.col("__take"))).drop("__take", "tokens")


def fixed_windows(segments: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """``(stream_id, window, text, n_tokens, first_page, last_page, pages)`` of ``segments(stream_id, seq, page_number, tokens)``."""
    rows = slices(segments, size, overlap)
    piece = F.struct("first", F.array_join("part", " ").alias("text"))
    return rows.groupBy("stream_id", "window").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), " ").alias("text"),
        F.sum(F.size("part")).cast("long").alias("n_tokens"),
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
        F.array_sort(F.collect_set("page_number")).alias("pages"),
    )


def page_counts(segments: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Tokens of each page in each window."""
    return slices(segments, size, overlap).groupBy("stream_id", "window", "page_number").agg(F.sum(F.size("part")).cast("long").alias("n_tokens"))


def block_coverage(segments: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Share of each block's tokens that a window holds, at most 1: ``(stream_id, window, block_id, n_tokens, coverage)``; segments also have ``block_id``."""
    total = segments.groupBy("stream_id", "block_id").agg(F.sum(F.size("tokens")).alias("__total"))
    inside = slices(segments, size, overlap).groupBy("stream_id", "window", "block_id").agg(F.sum(F.size("part")).cast("long").alias("n_tokens"), F.min("first").alias("first"))
    share = F.when(F.col("__total") > 0, F.least(F.lit(1.0), F.col("n_tokens") / F.col("__total"))).otherwise(F.lit(0.0))
    return inside.join(total, ["stream_id", "block_id"]).select("stream_id", "window", "block_id", "n_tokens", "first", share.alias("coverage"))


def records(windows: DataFrame, pages: DataFrame, prefix: str, semester: int = 2) -> DataFrame:
    """Windows as chunks: an id, the page range, and the lesson of the first page of ``pages(stream_id, page_number, ...)``."""
    meta = pages.withColumnRenamed("page_number", "first_page")
    named = F.concat(F.lit(f"{prefix}-s{semester}-p"), F.col("first_page").cast("string"), F.lit("-c"), F.col("window").cast("string"))
    out = windows.join(meta, ["stream_id", "first_page"], "left")
    return out.withColumn("chunk_id", named).withColumn("page_range", F.array("first_page", "last_page"))


def coverage_maps(coverage: DataFrame) -> DataFrame:
    """Long coverage as the nested columns of a chunk, blocks in order of appearance."""
    rows = F.array_sort(F.collect_list(F.struct("first", "block_id", "n_tokens", "coverage")))
    nested = coverage.groupBy("stream_id", "window").agg(rows.alias("__r"))
    return nested.select(
        "stream_id", "window", F.transform("__r", lambda x: x["block_id"]).alias("source_block_ids"),
        F.map_from_arrays(F.transform("__r", lambda x: x["block_id"]), F.transform("__r", lambda x: x["n_tokens"])).alias("source_block_unit_counts"),
        F.map_from_arrays(F.transform("__r", lambda x: x["block_id"]), F.transform("__r", lambda x: x["coverage"])).alias("source_block_coverage"),
    )


def block_unions(coverage: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(stream_id, window, diagram_image_urls, standards, has_diagram, has_math)`` of the blocks that gave a window text.

    ``blocks(block_id, position, diagram_image_urls, standards, has_diagram, has_math)``: lists are united in the order of
    ``position``, flags by or; a page's other blocks give nothing. Windows without known blocks have empty lists and no flags.
    """
    rows = coverage.select("stream_id", "window", "block_id").join(blocks, "block_id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "diagram_image_urls", "standards"))))
    out = rows.groupBy("stream_id", "window").agg(ordered.alias("__b"), *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("has_diagram", "has_math")])
    united = lambda c: F.array_distinct(F.flatten(F.transform("__b", lambda b: F.coalesce(b[c], F.array().cast("array<string>"))))).alias(c)
    return out.select("stream_id", "window", united("diagram_image_urls"), united("standards"), "has_diagram", "has_math")
