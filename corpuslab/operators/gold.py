"""Gold relevance of chunks, in long form: ``(qa_id, target_id, chunk_id, coverage, basis)``, a target without chunk kept with a null one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.blocks import page_of_block


def _targets(qa: DataFrame) -> DataFrame:
    return qa.select("qa_id", *[c for c in ("question_type", "gold_page") if c in qa.columns], F.posexplode("gold_source_block_ids").alias("target_pos", "target_id"))


def by_block(qa: DataFrame, chunk_blocks: DataFrame, least: float = 0.99) -> DataFrame:
    """Chunks that hold a gold block (``chunk_blocks(chunk_id, block_id, coverage)``, null coverage is whole)."""
    good = chunk_blocks.where(F.coalesce("coverage", F.lit(1.0)) >= least)
    out = _targets(qa).join(good, F.col("target_id") == F.col("block_id"), "left")
    return out.select("qa_id", "target_pos", "target_id", "chunk_id", "coverage", F.when(F.col("chunk_id").isNotNull(), F.lit("block_match")).alias("basis"))


def by_coverage(qa: DataFrame, chunk_blocks: DataFrame, chunk_pages: DataFrame, ordinary: float = 0.80, worked: float = 1.00) -> DataFrame:
    """Windows that hold enough of a gold block; blocks that no window holds fall back on windows that overlap its page.

    Worked examples need ``worked``, others ``ordinary``; null coverage is refused.
    ``chunk_pages(chunk_id, low, high)`` are page ranges; the page is the block id's or else the question's ``gold_page``.
    """
    targets = _targets(qa).withColumn("threshold", F.when(F.col("question_type") == "worked_example_reasoning", worked).otherwise(ordinary))
    hits = targets.join(chunk_blocks, (F.col("target_id") == F.col("block_id")) & (F.col("coverage") >= F.col("threshold")))
    hits = hits.select("qa_id", "target_pos", "target_id", "chunk_id", "coverage", F.lit("coverage").alias("basis"))
    rest = targets.join(hits.select("qa_id", "target_pos"), ["qa_id", "target_pos"], "left_anti").withColumn("page", F.coalesce(page_of_block(F.col("target_id")), F.col("gold_page")))
    near = rest.join(on_pages(chunk_pages), "page", "left")
    near = near.select("qa_id", "target_pos", "target_id", "chunk_id", F.lit(None).cast("double").alias("coverage"), F.when(F.col("chunk_id").isNotNull(), F.lit("page_overlap_fallback")).alias("basis"))
    return hits.unionByName(near)


def on_pages(chunk_pages: DataFrame) -> DataFrame:
    """A row for each page of each range, so that range joins are equi-joins."""
    return chunk_pages.where("low <= high").select("chunk_id", F.explode(F.sequence("low", "high")).alias("page"))


def by_page(qa: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """The proxy for systems without block provenance: chunks whose pages include a gold page."""
    targets = qa.select("qa_id", F.posexplode("gold_page_numbers").alias("target_pos", "page"))
    out = targets.join(on_pages(chunk_pages), "page", "left")
    return out.select("qa_id", "target_pos", F.col("page").cast("string").alias("target_id"), "chunk_id", F.lit(None).cast("double").alias("coverage"), F.when(F.col("chunk_id").isNotNull(), F.lit("page_overlap_proxy")).alias("basis"))


def status(qa: DataFrame, gold: DataFrame, complete: str = "complete") -> DataFrame:
    """``(qa_id, n_targets, n_mapped, mapping_status)``: complete if there are targets and each has a chunk."""
    per = gold.groupBy("qa_id", "target_pos").agg(F.max(F.col("chunk_id").isNotNull().cast("int")).alias("hit")).groupBy("qa_id").agg(F.count("*").alias("n_targets"), F.sum("hit").alias("n_mapped"))
    out = qa.select("qa_id").join(per, "qa_id", "left").fillna(0, ["n_targets", "n_mapped"])
    return out.withColumn("mapping_status", F.when((F.col("n_targets") > 0) & (F.col("n_targets") == F.col("n_mapped")), F.lit(complete)).otherwise(F.lit("incomplete")))


def unmapped(gold: DataFrame) -> DataFrame:
    """Targets without any chunk."""
    none = gold.groupBy("qa_id", "target_id").agg(F.count("chunk_id").alias("n")).where("n = 0")
    return none.select("qa_id", "target_id", F.lit("high").alias("severity"))
