"""Flat tables of summaries, and their rendering on the driver (they are a few rows by nature)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overall(summaries: DataFrame) -> DataFrame:
    """One row for each system; recalls of different kinds have columns of their own."""
    unit = F.col("granularity") == "unit"
    return summaries.select("system", "n_questions", "mrr", "hit_at_1", "hit_at_5", F.when(unit, F.col("recall")).alias("gold_unit_recall"), F.when(~unit, F.col("recall")).alias("gold_page_recall_proxy"))


def error_rates(summary: DataFrame) -> DataFrame:
    """Errors over attempts, 0 without attempts."""
    return summary.withColumn("error_rate", F.when(F.col("n_attempted") > 0, F.col("n_errored") / F.col("n_attempted")).otherwise(F.lit(0.0)))


def ordered(rows: DataFrame, column: str, canonical: tuple[str, ...]) -> DataFrame:
    """Canonical values first, others after them by name."""
    place = F.array_position(F.array(*[F.lit(c) for c in canonical]), F.col(column))
    return rows.orderBy(F.when(place == 0, len(canonical) + 1).otherwise(place), column)


def show(value: object, kind: str = "") -> str:
    """A cell: ``yes``/``no``, four decimals, percent (``%``, signed ``+%``), thousands (``n``), a dash for nothing."""
    if value is None or value != value:
        return "—"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if kind in ("%", "+%"):
        return f"{100 * value:{'+' if kind == '+%' else ''}.1f}%"
    if kind == "n":
        return f"{int(value):,}"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(rows: DataFrame, title: str, kinds: dict[str, str] | None = None, most: int = 1000) -> str:
    """A table of a report; more than ``most`` rows is not a report and raises."""
    data = rows.limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"over {most} rows")
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    body = "\n".join("| " + " | ".join(show(r[c], (kinds or {}).get(c, "")) for c in rows.columns) + " |" for r in data)
    return f"## {title}\n\n{head}\n{body}\n"
