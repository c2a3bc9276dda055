"""Context under a token budget, in closed form.

A hit joins while the untruncated total before it and its header stay below the budget; its
body is cut to what is left. Once one is cut or refused, every later total is over
the budget, so plain prefix sums suffice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.text import estimated_tokens, ws_tokens


def assemble(hits: DataFrame, budget: int = 2560, header: int = 2) -> DataFrame:
    """``(qa_id, context, chunk_ids, token_count, truncated, char_count, estimated_tokens)`` of ``hits(qa_id, rank, chunk_id, text)``; bodies are joined by blank lines under ``[rank] id``."""
    rows = hits.withColumn("t", ws_tokens(F.col("text"))).withColumn("b", F.size("t").cast("long"))
    before = F.coalesce(F.sum(F.col("b") + header).over(W.partitionBy("qa_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("prev", before)
    fits = F.col("prev") + header < budget
    rows = rows.withColumn("fits", fits).withColumn("take", F.when(fits, F.least(F.col("b"), budget - F.col("prev") - header)).otherwise(F.lit(0)))
    rows = rows.withColumn("cut", (F.col("prev") + header + F.col("b") > budget) | ~fits)
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_id").cast("string"))
    piece = F.when(F.col("fits"), F.struct("rank", F.col("chunk_id").alias("id"), F.concat(head, F.lit("\n"), F.array_join(F.slice("t", F.lit(1), F.greatest(F.col("take"), F.lit(0)).cast("int")), " ")).alias("text")))
    out = rows.groupBy("qa_id").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("take") + header)), F.lit(0)).alias("token_count"), F.bool_or("cut").alias("truncated"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    out = out.withColumn("context", text).withColumn("char_count", F.length("context").cast("long"))
    return out.select("qa_id", "context", F.transform("p", lambda x: x["id"]).alias("chunk_ids"), "token_count", "truncated", "char_count", estimated_tokens(F.col("char_count")).alias("estimated_tokens"))


def verify(rebuilt: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rebuilt contexts against recorded ones: ``verified_recorded_generator_context`` only if chunks, tokens and truncation agree."""
    both = rebuilt.select("qa_id", "chunk_ids", "token_count", "truncated").join(recorded.select("qa_id", F.col("chunk_ids").alias("r_ids"), F.col("token_count").alias("r_tokens"), F.col("truncated").alias("r_cut")), "qa_id", "left")
    same = F.col("chunk_ids") == F.col("r_ids")
    verdict = F.when(F.col("r_ids").isNull(), "no_record").when(~same, "chunks_differ").when(F.col("token_count") != F.col("r_tokens"), "tokens_differ").when(F.col("truncated") != F.col("r_cut"), "truncation_differs").otherwise("verified_recorded_generator_context")
    return both.select("qa_id", verdict.alias("context_source"))


def mock_answer(context: F.Column) -> F.Column:
    """The first 40 tokens of the context, or the fixed abstention."""
    tokens = ws_tokens(context)
    return F.when(F.size(tokens) == 0, F.lit("لا يوجد في السياق المُقدَّم.")).otherwise(F.array_join(F.slice(tokens, 1, 40), " "))
