"""Exact lexical and dense top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.text import word_tokens


def token_rows(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, norm, token)``, a row for each token; ``norm`` is the Euclidean norm of the text's token counts.

    Sorted tokens are compared with their successors; counts are the distances of the ends of
    runs. Every step is linear and a projection of its own below the explode, so that none is
    computed again for each token.
    """
    t = texts.select(key, word_tokens(F.col(text)).alias("t"))
    rows = t.select(key, "t", F.sort_array("t").alias("s"))
    following = F.concat(F.expr("slice(s, 2, greatest(size(s) - 1, 0))"), F.array(F.lit(None).cast("string")))
    rows = rows.select(key, "t", F.zip_with("s", following, lambda x, y: ~x.eqNullSafe(y)).alias("last"))
    rows = rows.select(key, "t", F.filter(F.transform("last", lambda x, i: F.when(x, i + 1).otherwise(F.lit(0))), lambda i: i > 0).alias("ends"))
    before = F.concat(F.array(F.lit(0)), F.expr("slice(ends, 1, greatest(size(ends) - 1, 0))"))
    square = F.zip_with("ends", before, lambda x, y: ((x - y) * (x - y)).cast("double"))
    rows = rows.select(key, "t", F.sqrt(F.aggregate(square, F.lit(0.0), lambda a, x: a + x)).alias("norm"))
    return rows.select(key, "norm", F.explode("t").alias("token"))


def ranked(scores: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """The best ``k`` of each query by unrounded score, ties by id; scores are then rounded to six places."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), F.asc(item)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("int"))


#: Characters of query texts that are sent to all tasks; larger sets are joined by shuffle. Scores and matches held at a time.
SENT_CHARS, SCORES, MATCHES = 16_000_000, 1 << 22, 1 << 22


class _Terms:
    """Queries as postings: for each term, by its hash, the queries that have it and how often."""

    def __init__(self, ids: list, tokens: list[np.ndarray]):
        self.ids = ids
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        term, query, count = _counted(np.concatenate([*tokens, np.zeros(0, dtype=np.int64)]), sizes)
        self.norm = np.sqrt(np.bincount(query, count.astype(np.float64) ** 2, len(ids)))
        self.vocabulary, number = np.unique(term, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.at = np.searchsorted(number[order], np.arange(len(self.vocabulary) + 1))
        self.query, self.count = query[order], count[order]

    def best(self, tokens: np.ndarray, sizes: np.ndarray, k: int):
        """``(document, query, score)`` of the best ``k`` documents of each query; ties go to documents that stand earlier."""
        term, doc, count = _counted(tokens, sizes)
        norm = np.sqrt(np.bincount(doc, count.astype(np.float64) ** 2, len(sizes)))
        place = np.minimum(np.searchsorted(self.vocabulary, term), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[place] == term if len(self.vocabulary) else np.zeros(len(term), dtype=bool)
        place, doc, count = place[known], doc[known], count[known]
        many = self.at[place + 1] - self.at[place]
        work = np.concatenate(([0], np.cumsum(np.bincount(doc, many, len(sizes)))))
        start, n = 0, len(self.ids)
        while start < len(sizes):
            stop = min(start + max(1, SCORES // n), max(start + 1, int(np.searchsorted(work, work[start] + MATCHES, side="right")) - 1))
            lo, hi = np.searchsorted(doc, (start, stop))
            reps = many[lo:hi]
            post = np.repeat(self.at[place[lo:hi]] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            cell = np.repeat(doc[lo:hi] - start, reps) * n + self.query[post]
            dot = np.bincount(cell, np.repeat(count[lo:hi], reps) * self.count[post].astype(np.float64), (stop - start) * n).reshape(-1, n)
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(dot > 0, dot / (norm[start:stop, None] * self.norm), 0.0)
            top = np.argsort(-score, axis=0, kind="stable")[:k]
            value = np.take_along_axis(score, top, axis=0)
            rows, cols = np.nonzero(value > 0)
            yield start + top[rows, cols], cols, value[rows, cols]
            start = stop


def _counted(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text, the text's number, and how often it has the token."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return tokens[first], owner[first], np.diff(np.append(first, len(tokens)))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, query: str = "qa_id", item: str = "chunk_id") -> DataFrame:
    """Cosine of token counts; only chunks that share a token are scored: ``(query, item, rank, score)``.

    The queries' terms are sent to all tasks (their size is checked first; a row is a query). A task finishes the
    scores of its chunks and hands on the best ``k`` of each query in a batch, so neither texts nor partial
    sums are shuffled. Tokens are cut by expressions and compared by 64-bit hashes. Rows without id are left out.
    """
    if (queries.agg(F.sum(F.length("text"))).first()[0] or 0) > SENT_CHARS:
        return _by_shuffle(queries, chunks, k, query, item)
    hashed = lambda df, key: df.where(F.col(key).isNotNull()).select(key, F.transform(word_tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("t")).where(F.size("t") > 0)
    asked = hashed(queries, query).collect()
    terms = _Terms([r[0] for r in asked], [np.array(r[1], dtype=np.int64) for r in asked])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((queries, query), (chunks, item)))
    shared = chunks.sparkSession.sparkContext.broadcast(terms)

    def run(parts):
        for pdf in parts:
            pdf = pdf.sort_values(item)
            tokens = [np.asarray(t, dtype=np.int64) for t in pdf["t"]]
            for doc, q, score in shared.value.best(np.concatenate(tokens), np.array([len(t) for t in tokens]), k) if tokens and shared.value.ids else ():
                yield pd.DataFrame({query: [shared.value.ids[i] for i in q.tolist()], item: pdf[item].iloc[doc].array, "score": score})

    return ranked(hashed(chunks, item).mapInPandas(run, f"{kinds}, score double"), query, item, k)


def _by_shuffle(queries: DataFrame, chunks: DataFrame, k: int, query: str, item: str) -> DataFrame:
    """The same for query sets too large to send: tokens meet by a join, each adding its term's count in the query."""
    q = token_rows(queries, query).groupBy(query, "token").agg(F.count("*").alias("qtf"), F.first("norm").alias("qn"))
    both = token_rows(chunks, item).join(q, "token")
    scored = both.groupBy(query, item).agg(F.sum("qtf").cast("double").alias("dot"), F.first("norm").alias("cn"), F.first("qn").alias("qn"))
    return ranked(scored.select(query, item, (F.col("dot") / (F.col("cn") * F.col("qn"))).alias("score")), query, item, k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Query vectors of a block, and blocks that one scan holds against all rows.
QUERY_BLOCK, BLOCKS = 4096, 16


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, query: str = "qa_id", item: str = "chunk_id") -> DataFrame:
    """Exact cosine of ``values``: the stated queries, in blocks of bounded size, against all rows.

    Blocks are broadcast, several to a scan; the window's group limit leaves ``k`` rows of
    each query and task before the shuffle. Null, empty and zero vectors match nothing.
    """
    unit = lambda df: df.withColumn("n", F.sqrt(_dot(F.col("values"), F.col("values")))).where("n > 0")
    q = unit(queries.select(query, "values"))
    v = unit(vectors.select(item, "values"))
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    q = q.withColumn("block", F.pmod(F.xxhash64(query), F.lit(n)))
    out = None
    for i in range(0, n, BLOCKS):
        block = q.where(F.col("block").between(i, i + BLOCKS - 1)).groupBy("block").agg(F.collect_list(F.struct(query, "values", "n")).alias("qs"))
        pairs = v.join(F.broadcast(block)).select(item, "values", "n", F.explode("qs").alias("q"))
        part = pairs.select(F.col(f"q.{query}").alias(query), item, (_dot(F.col("values"), F.col("q.values")) / (F.col("n") * F.col("q.n"))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return ranked(out, query, item, k)
