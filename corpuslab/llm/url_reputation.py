"""Empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes are counted by host. A beta-binomial prior, fitted by the
method of moments, shrinks each suffix towards the rate of all labels, each
registered domain towards its suffix and each host towards its registered domain.
A page is blocked where the lower posterior bound of its host's bad rate exceeds
a threshold; hosts without labels fall back on the posterior of the nearest
ancestor that has some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import ascii_lower, saved

#: (verdict, rule): a rule is a host, then a path prefix.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
Z, THRESHOLD = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null: its host or a subdomain of it, and a path that starts with its path."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        on_host = (host == rule[:at]) | host.endswith("." + rule[:at])
        found = F.when(on_host & path.startswith(rule[at:]), F.lit(rule)).otherwise(found)
    return found


# Labels that make a suffix of two labels with a country's two letters, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "ne", "net", "or", "org")


def _levels(df: DataFrame) -> DataFrame:
    """Registered domain and suffix of ``__host``, its port aside.

    The suffix is the last label, or the last two where they are one of ``SECOND_LEVEL`` and two letters; the registered
    domain has one label more. Numeric addresses are domains of their own under the suffix ``ip``.
    """
    h = F.regexp_replace("__host", r":[0-9]*$", "")
    numeric, two = h.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"), h.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    domain = F.when(numeric, h).when(two, F.substring_index(h, ".", -3)).otherwise(F.substring_index(h, ".", -2))
    suffix = F.when(numeric, F.lit("ip")).when(two, F.substring_index(h, ".", -2)).otherwise(F.substring_index(h, ".", -1))
    return df.withColumn("__domain", domain).withColumn("__suffix", suffix)


def _shrunk(child: DataFrame, parent: DataFrame, key: str, up: str) -> DataFrame:
    """Posterior ``(key, a, b)`` of each child under a beta prior around its parent's posterior mean.

    Method of moments over all children of the level: weighted squared deviations
    from the parents' means are mu(1-mu) * (1 + (n-1) rho) / n in expectation,
    and the prior's strength is 1/rho - 1.
    """
    both = child.join(parent.select(F.col(up).alias("__up"), (F.col("a") / (F.col("a") + F.col("b"))).alias("mu")), F.col(up) == F.col("__up"))
    spread = F.col("mu") * (1 - F.col("mu"))
    sums = both.agg(
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mu"), F.lit(2.0))), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(spread), F.lit(0.0)).alias("v0"),
        F.coalesce(F.sum(spread * (F.col("n") - 1)), F.lit(0.0)).alias("v1"),
    )
    rho = F.greatest(F.when(F.col("v1") > 0, (F.col("s") - F.col("v0")) / F.col("v1")).otherwise(0.0), F.lit(1e-9))
    strength = F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), 1 / rho - 1))
    # one row of three sums: its size is fixed
    both = both.crossJoin(F.broadcast(sums.select(strength.alias("k"))))
    return both.select(*[c for c in child.columns], (F.col("k") * F.col("mu") + F.col("bad")).alias("a"), (F.col("k") * (1 - F.col("mu")) + F.col("n") - F.col("bad")).alias("b"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, bad_bound)``, a row for each row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)``: 1 for a bad page, 0 for a good one; several rows of
    a page count each, nulls and pages that are not there count nothing. A rule's
    verdict stands above the reputation's. Null or odd urls have empty host and
    path and the reputation of the empty host. Without any label every page
    has bound 0 and is allowed. Repeated page ids keep a row each and share outcomes.
    Other columns are ignored.
    """
    pages = pages.select("page_id", host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"))
    known = outcomes.select(F.col("page_id").alias("__page"), F.col("bad").cast("double").alias("__bad")).where("__page is not null and __bad is not null")
    known = known.groupBy("__page").agg(F.sum("__bad").alias("__bad"), F.count("*").alias("__n"))
    labelled = pages.where("page_id is not null").join(known, pages["page_id"] == known["__page"])
    # written once: each level is made from the counts, not from the pages again
    host = saved(_levels(labelled.groupBy("__host").agg(F.sum("__n").cast("double").alias("n"), F.sum("__bad").alias("bad"))), "hosts")
    domain = host.groupBy("__domain", "__suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = host.groupBy("__suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("__top", F.lit(1))
    total = host.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1).alias("a"), (F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0.0)) + 1).alias("b")).withColumn("__top", F.lit(1))
    suffix = saved(_shrunk(suffix, total, "__suffix", "__top"), "suffixes")
    domain = saved(_shrunk(domain, suffix, "__domain", "__suffix"), "domains")
    host = _shrunk(host, domain, "__host", "__domain")

    def bound() -> Column:
        n = F.col("a") + F.col("b")
        mean = F.col("a") / n
        return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (n + 1)))

    # a verdict for each distinct host, so that a hot host is looked up once
    every = _levels(pages.select("__host").distinct())
    every = every.join(suffix.select("__suffix", bound().alias("b3")), "__suffix", "left")
    every = every.join(domain.select("__domain", bound().alias("b2")), "__domain", "left")
    every = every.join(host.select("__host", bound().alias("b1")), "__host", "left")
    # written, so that the join can split the pages of one host
    every = saved(every.select(F.col("__host").alias("__h"), F.coalesce("b1", "b2", "b3", F.lit(0.0)).alias("bad_bound")), "verdicts")
    out = pages.join(every, pages["__host"] == every["__h"]).withColumn("rule", rule_for(F.col("__host"), F.col("__path"), rules))
    by_rule = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("bad_bound") > threshold, "block").otherwise("allow"))
    return out.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "rule", verdict.alias("verdict"), "bad_bound")
