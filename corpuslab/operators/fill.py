"""Forward fill of metadata groups over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Places of ``order`` that one task fills.
STRIP = 4096


def forward_fill(pages: DataFrame, groups: dict[str, tuple[str, ...]], by: str = "book", order: str = "page_number", strip: int = STRIP) -> DataFrame:
    """Each group (a number and what belongs to it) from the last page that has the number.

    The whole group is inherited: a title on a page without a number is replaced,
    and a number without a title keeps none. 0 and the empty string are no numbers. Groups
    are filled independently; pages before the first number stay as they are.

    A long book isn't one task: pages are filled within strips of ``strip`` places, and only the last
    group of each strip is handed on to the strips after it. ``order`` is a whole number; rows without it come first.
    """
    names = list(groups)
    whole = {n: F.struct(n, *groups[n]) for n in names}
    text = {n: F.col(n).cast("string") for n in names}
    given = {n: F.coalesce((text[n] != "") & (text[n] != "0"), F.lit(False)) for n in names}
    rows = pages.withColumn("__strip", F.floor(F.col(order) / strip))
    last = [F.max_by(F.when(given[n], whole[n]), F.when(given[n], F.struct(F.col(order).isNotNull(), order))).alias(f"__l{i}") for i, n in enumerate(names)]
    earlier = W.partitionBy("__by").orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    strips = rows.groupBy(F.col(by).alias("__by"), F.col("__strip").alias("__s")).agg(*last)
    strips = strips.select("__by", "__s", *[F.last(f"__l{i}", ignorenulls=True).over(earlier).alias(f"__e{i}") for i in range(len(names))])
    rows = rows.join(strips, rows[by].eqNullSafe(strips["__by"]) & rows["__strip"].eqNullSafe(strips["__s"]), "left")
    before = W.partitionBy(by, "__strip").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    filled = {f"__g{i}": F.when(given[n], whole[n]).otherwise(F.coalesce(F.last(F.when(given[n], whole[n]), ignorenulls=True).over(before), F.col(f"__e{i}"), whole[n])) for i, n in enumerate(names)}
    rows = rows.withColumns(filled)
    source = {c: f"__g{i}.{c}" for i, n in enumerate(names) for c in (n, *groups[n])}
    return rows.select(*[F.col(source[c]).alias(c) if c in source else F.col(c) for c in pages.columns])
