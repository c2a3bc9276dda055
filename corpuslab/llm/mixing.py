"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (by a digest of their ids) and
are queued twice over. A document's virtual finish time is the source's tokens
up to its end, divided by the source's target; documents leave in that order
until the total budget is spent. A document that crosses its source's target is
split there, so the mix ends within rounding of every target.

Running sums never need all rows of a source in one task: rows are dealt by a
prefix of the digest (within a source) and by slices of virtual time (over all),
and the few sums of the slices carry the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.llm.common import saved, word_count

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
SALT = "mix"
#: Rows that a slice of a running sum should hold.
SLICE = 20_000


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` of ``sized(source, size)``: weights by rank of the source, targets capped and the excess reshared."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranks without one task for all sources: range partitions, then offsets of partitions
    parts = saved(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "sources")
    before = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__off", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))
    ranked = parts.join(before.select("__part", "__off"), "__part").withColumn("__rank", F.coalesce("__off", F.lit(0)) + F.row_number().over(W.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = saved(ranked.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")).alias("__w"), (F.lit(float(cap)) * F.col("source_size")).alias("__cap")), "ranks")
    total = ranked.agg(F.sum("source_size").alias("s"), F.sum("__w").alias("w")).first()
    budget, level = share * (total["s"] or 0), None
    new = budget / total["w"] if total["w"] else 0.0
    while new != level and new is not None:  # the level only rises, and with each step a source reaches its cap
        level = new
        over = F.col("__w") * F.lit(level) > F.col("__cap")
        x = ranked.agg(F.sum(F.when(over, F.col("__cap"))).alias("full"), F.sum(F.when(~over, F.col("__w"))).alias("w")).first()
        new = (budget - (x["full"] or 0.0)) / x["w"] if x["w"] else level
    return ranked.select("source", "source_size", F.least(F.col("__w") * F.lit(level), F.col("__cap")).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, salt: str = SALT) -> DataFrame:
    """Entries of the mix, ``(doc_id, source, size, source_size, target, place, epoch, finish, words)``.

    ``place`` numbers the rows of a source in the shuffled order, ``finish`` is the
    virtual finish time, ``words`` what the mix takes of the entry (0: after the
    budget's end). Sizes are runs of anything but ASCII white space, null texts have 0.
    Null sources are one source, last in order. Rows that repeat take part each;
    a null ``doc_id`` is replaced by the text's digest. No rows give no rows. The budget is the sum of the whole words of all targets,
    so the cut ends the queue where every source is spent; a smaller ``share`` or a ``cap`` moves both.
    """
    # rows without id are shuffled by their texts
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")))))
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{salt}|"), name)).alias("__h")), "sizes")
    targets = saved(source_targets(sized, weights, share, cap), "targets")
    n = sized.count()
    budget = targets.agg(F.coalesce(F.sum(F.floor(F.col("target") + 1e-6)), F.lit(0))).first()[0]  # in whole words
    digits, slices = 1, max(8, n // SLICE)
    while 16**digits * SLICE < n * 4 and digits < 8:
        digits += 1
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    rows = sized.withColumn("__key", key(F.col("source"))).withColumn("__cell", F.substring("__h", 1, digits))
    cells = rows.groupBy("__key", "__cell").agg(F.sum("size").alias("__s"), F.count("*").alias("__c"))
    ahead = W.partitionBy("__key").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("__key", "__cell", F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0"), F.coalesce(F.sum("__c").over(ahead), F.lit(0)).alias("__c0"))
    cells = cells.join(targets.select(key(F.col("source")).alias("__key"), "source_size", "target"), "__key")
    inside = W.partitionBy("__key", "__cell").orderBy("__h", "doc_id", "size")
    rows = rows.join(cells, ["__key", "__cell"])
    rows = rows.withColumn("__end", F.col("__s0") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("place", F.col("__c0") + F.row_number().over(inside))
    # both passes over the queue, split where they cross the source's target
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    goal = F.floor(F.col("target") + 1e-6)
    rows = rows.withColumn("__b", F.col("epoch") * F.col("source_size") + F.col("__end")).withColumn("__a", F.col("__b") - F.col("size"))
    rows = rows.withColumn("__mid", F.least(F.col("__b"), F.greatest(F.col("__a"), goal)))
    part = lambda lo, hi: F.struct((F.col(hi) - F.col(lo)).alias("w"), F.col(hi).alias("end"))
    rows = rows.withColumn("__part", F.explode(F.array(part("__a", "__mid"), part("__mid", "__b")))).where((F.col("__part.w") > 0) | (F.col("size") == 0))
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, F.col("__part.end") / F.greatest(goal.cast("double"), F.lit(1.0))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("__slice", F.least(F.floor((F.col("finish") - 1e-12) * slices), F.lit(4 * slices)).cast("int"))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "place", "epoch", "finish", F.col("__part.w").alias("__words"), "__slice", "__key")
    rows = saved(rows, "queue")
    sums = rows.groupBy("__slice").agg(F.sum("__words").alias("__sw"))
    sums = sums.select("__slice", F.coalesce(F.sum("__sw").over(W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    rows = rows.join(sums, "__slice")
    spent = F.col("__off") + F.sum("__words").over(W.partitionBy("__slice").orderBy("finish", "__key", "epoch", "place").rowsBetween(W.unboundedPreceding, 0)) - F.col("__words")
    done = rows.where(F.col("__off") >= budget).withColumn("words", F.lit(0).cast("long"))
    live = rows.where(F.col("__off") < budget).withColumn("words", F.greatest(F.lit(0), F.least(F.col("__words"), budget - spent)).cast("long"))
    return live.unionByName(done).drop("__slice", "__words", "__key", "__off")


def mixed_documents(docs: DataFrame, **knobs) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, a row for each row of ``docs``: words that the mix takes, repeats counted."""
    plan = mix_plan(docs, **knobs)
    out = plan.groupBy("source", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_stream(docs: DataFrame, **knobs) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: ``mix_plan``'s entries with words, and the document's columns once for each.

    Of k rows of one id each is joined with one of the id's k places in the plan.
    """
    plan = mix_plan(docs, **knobs)
    nth = F.dense_rank().over(W.partitionBy("doc_id").orderBy("source", "place"))
    plan = plan.withColumn("__nth", nth).where("words > 0").select(F.col("doc_id").alias("__id"), "__nth", "finish", "epoch", "words")
    rows = docs.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("source", word_count(F.col("text")))))
    return rows.join(plan, rows["doc_id"].eqNullSafe(plan["__id"]) & (rows["__n"] == plan["__nth"])).drop("__id", "__n", "__nth").orderBy("finish", "doc_id", "epoch")
