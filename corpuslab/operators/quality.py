"""Character error rates, samples and checks across artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import squash


def cer_rows(sheet: DataFrame, reference: str, hypothesis: str, keys: tuple[str, ...]) -> DataFrame:
    """Edits, length and rate of each row; blank references are skipped."""
    plain = sheet.select(*keys, squash(F.col(reference)).alias("__r"), squash(F.col(hypothesis)).alias("__h")).where("__r <> ''")
    # the distance is a column before its share is taken, so that it is computed once
    rows = plain.select(*keys, F.levenshtein("__r", "__h").alias("edits"), F.length("__r").alias("length"))
    return rows.withColumn("cer", F.col("edits") / F.col("length"))


def cer_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Micro rate (edits over characters), macro rate (mean of rates), number of rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("edits") / F.sum("length"), 6).alias("micro_cer"), F.round(F.avg("cer"), 6).alias("macro_cer"))


def sample(rows: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer), by the digest of seed and key."""
    return rows.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)


def first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows; 0 is no limit."""
    return rows.orderBy(*order).limit(n) if n else rows


def same_questions(records: DataFrame, key: str = "qa_id", value: str = "question_type", system: str = "system") -> DataFrame:
    """Questions that some system lacks, has twice, or types differently: no rows if the systems agree."""
    systems = records.select(system).distinct().agg(F.count("*").alias("systems"))
    per = records.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(system).alias("n_systems"), F.countDistinct(F.coalesce(value, F.lit(""))).alias("n_types"))
    return per.join(F.broadcast(systems)).where("n <> n_systems or n_systems <> systems or n_types > 1").drop("systems")


def same_protocol(configs: DataFrame, *settings: str) -> DataFrame:
    """Whether all runs share their critical settings."""
    return configs.agg((F.countDistinct(F.struct(*[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in settings])) <= 1).alias("same_protocol"))
