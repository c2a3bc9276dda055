"""Union-find over distributed links, and the resolution of candidate buckets into classes.

Nothing here forms all pairs of a bucket. One or two pivots of each bucket are compared
with its members; only members that this leaves outside the bucket's largest
class are compared with the rest, in blocks of bounded size, each block a task
of its own, which returns the links it finds and no pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import saved

#: Rows of one side of a block of the last comparison.
BLOCK = 256
ROUNDS = 60


def _forest(parts):
    """Union-find within a partition: each node once, with the smallest node that its links reach."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in parts:
        for a, b in zip(pdf["u"], pdf["v"]):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in parent if (r := find(x)) != x]
    yield pd.DataFrame({"u": pd.Series([r for _, r in rows], dtype=object), "v": pd.Series([x for x, _ in rows], dtype=object)})


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(u, v)``: ``(id, root)``, root the smallest id reached, for each id in a link.

    Self-links and nulls are ignored; no links give no rows. Each partition first
    contracts its links to a forest; then every node hands its smallest neighbour to
    the others (aggregates and joins only, so a node of many links is split).
    """
    kind = links.schema["u"].dataType.simpleString()
    links = links.where("u is not null and v is not null and u <> v").select("u", "v")
    edges = saved(links.mapInPandas(_forest, f"u {kind}, v {kind}").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join can split the links of one node
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        edges = saved(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct(), "edges")
        # small star: a node and its smaller neighbours go to the smallest of these
        least = edges.groupBy("v").agg(F.min("u").alias("m"))
        handed = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = saved(handed.unionByName(least.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())


def resolve(buckets: DataFrame, payloads: DataFrame | Callable[[DataFrame], DataFrame], pairs: Callable, block: Callable | None, votes: int = 1, pivots: int = 2) -> DataFrame:
    """Classes ``(id, root)`` of ids that share a bucket and match, directly or through others.

    ``buckets(key, id)``: candidates, each once, cheap to read again; ``payloads``: a written table ``(id, payload binary)``, or a function that makes it
    for the ids asked for; ``pairs(list, list)``: which pairs match;
    ``block(list, list)``: the matrix of matches, or None to leave it at pivots. A
    pivot pair needs ``votes`` shared buckets; the blocks compare whatever shares one. Ids that match nothing have no row.
    """
    rank = [F.xxhash64(F.lit(s + 1), "id") for s in range(pivots)]
    full = buckets.groupBy("key").agg(F.count("*").alias("n"), *(F.min_by("id", r).alias(f"p{i}") for i, r in enumerate(rank))).where("n > 1")
    full = saved(full, "pivots")  # a written table, so that the join can split the rows of a hot bucket
    # pivots meet all pairs of small buckets: their keys aren't needed again
    buckets = buckets.join(full, "key").withColumn("key", F.when(F.col("n") > pivots + 1, F.col("key")))
    if block is not None:
        buckets = saved(buckets, "full-buckets")
    asked = buckets.select("id", F.explode(F.array(*[f"p{i}" for i in range(pivots)])).alias("p")).where("id <> p")
    asked = asked.select(F.least("id", "p").alias("u"), F.greatest("id", "p").alias("v")).groupBy("u", "v").agg(F.count("*").alias("n")).where(F.col("n") >= votes).select("u", "v")
    asked = saved(asked, "asked")
    load = payloads if isinstance(payloads, DataFrame) else saved(payloads(asked.select(F.explode(F.array("u", "v")).alias("id")).distinct()), "payloads")

    def confirm(parts):
        for pdf in parts:
            yield pdf[np.asarray(pairs(list(pdf["pu"]), list(pdf["pv"])), dtype=bool)][["u", "v"]]

    kind = buckets.schema["id"].dataType.simpleString()
    with_u = asked.join(load.select(F.col("id").alias("u"), F.col("payload").alias("pu")), "u")
    links = with_u.join(load.select(F.col("id").alias("v"), F.col("payload").alias("pv")), "v")
    links = saved(links.mapInPandas(confirm, f"u {kind}, v {kind}"), "links")
    classes = saved(components(links), "classes")
    if block is None:
        return classes

    # members that stand outside the largest class of a bucket, against the whole bucket
    at = buckets.where("key is not null").select("key", "id", "n").join(classes, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("c"))
    size = at.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    open_ = size.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.max("k").alias("most"), F.sum("k").alias("all"), F.sum("h").alias("h")).where("most < all")
    # buckets of the same members are compared once
    open_ = open_.groupBy("h", "all").agg(F.min_by(F.struct("key", "top", "most"), "key").alias("b")).select("b.*", "all")
    at = saved(at.join(open_, "key").withColumn("odd", F.col("c") != F.col("top")), "open")
    rows_, cols = F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    here = F.abs(F.xxhash64(F.lit(3), "id"))
    left = at.where("odd").select("key", "id", "c", F.lit(True).alias("odd"), (here % rows_).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), cols - 1)).alias("j"))
    right = at.select("key", "id", "c", F.lit(False).alias("odd"), F.explode(F.sequence(F.lit(0), rows_ - 1)).alias("i"), (here % cols).cast("int").alias("j"))
    cells = left.unionByName(right)
    load2 = payloads if isinstance(payloads, DataFrame) else payloads(at.select("id").distinct())
    cells = cells.join(load2, "id")

    def compare(rows: list[tuple]) -> list[tuple]:
        a, b = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        found = []
        if a and b:
            hit = block([r[5] for r in a], [r[5] for r in b])
            for x in range(len(a)):
                seen = {a[x][4]}
                for y in np.flatnonzero(hit[x]):
                    if b[y][4] not in seen:
                        seen.add(b[y][4])
                        found.append((a[x][6], b[y][6]))
        return found

    def compared(parts):
        rows, cell = [], None
        columns = lambda found: pd.DataFrame({"u": pd.Series([f[0] for f in found], dtype=object), "v": pd.Series([f[1] for f in found], dtype=object)})
        for pdf in parts:
            found = []
            for row in pdf[["key", "i", "j", "odd", "c", "payload", "id"]].itertuples(index=False, name=None):
                if row[:3] != cell:
                    found += compare(rows)
                    rows, cell = [], row[:3]
                rows.append(row)
            yield columns(found)
        yield columns(compare(rows))

    # cells of a partition one after the other: a task for each small bucket would cost more than its work
    more = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(compared, f"u {kind}, v {kind}")
    more = saved(more, "more-links")
    return components(links.unionByName(more))
