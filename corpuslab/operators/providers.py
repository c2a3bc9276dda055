"""External models behind one interface, with offline stand-ins.

A provider is a picklable function over a list of prompts or texts; it runs on the
executors in Arrow batches. Paid calls are not repeated by speculation: keep
``spark.speculation`` off for runs with real providers.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions import judging

Embed = Callable[[list[str]], list[list[float]]]
Reply = Callable[[list[str]], list[str]]


def hashing_embedder(dim: int = 64) -> Embed:
    """A stand-in: signed feature hashing of words, unit length; empty texts give zeros."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embed(rows: DataFrame, key: str, text: str, provider: Embed, batch: int = 64) -> DataFrame:
    """``(key, values)``; texts go out in batches, and a batch that comes back with another length raises."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                values = provider([t if isinstance(t, str) else "" for t in some[text]])
                if len(values) != len(some):
                    raise ValueError(f"{len(some)} texts gave {len(values)} vectors")
                yield pd.DataFrame({key: some[key].array, "values": values})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, values array<float>")


def mock_judge(prompts: list[str]) -> list[str]:
    """The stand-in judge's replies: scores from the prompts' digests."""
    return [f'{{"score": {int(hashlib.sha256(p.encode()).hexdigest()[:8], 16) % 1001 / 1000}, "rationale": "digest"}}' for p in prompts]


CALLS = "array<struct<attempt: int, prompt_sha256: string, prompt_chars: int, raw_response: string, error: string, latency_ms: long, at: timestamp>>"


def scored(reply: str | None) -> bool:
    """Whether a reply is a JSON object with a score in [0, 1]; recovered scores are not enough to stop."""
    try:
        score = json.loads(judging._balanced(judging.bare(reply or "")) or "null")["score"]
        return 0 <= float(score) <= 1
    except (ValueError, TypeError, KeyError):
        return False


def ask(rows: DataFrame, prompt: str, provider: Reply, max_retries: int = 2, good: Callable[[str | None], bool] = scored, batch: int = 32) -> DataFrame:
    """``rows`` with ``calls``: up to ``max_retries`` + 1 attempts each, until one is good; errors are kept as text.

    A provider gets up to ``batch`` prompts at a time; if it fails with several, each is asked alone.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def asked(prompts: list[str]) -> list[tuple]:
        start = time.monotonic()
        try:
            replies = provider(prompts)
            if len(replies) != len(prompts):
                raise ValueError("a reply for each prompt is needed")
            return [(r, None, start) for r in replies]
        except Exception as e:  # a failed call is a recorded outcome
            return [(None, f"{type(e).__name__}: {e}", start)] if len(prompts) == 1 else [x for p in prompts for x in asked([p])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            prompts = list(pdf[prompt])
            logs: list[list] = [[] for _ in prompts]
            left = list(range(len(prompts)))
            for attempt in range(max_retries + 1):
                again = []
                for lo in range(0, len(left), batch):
                    some = left[lo : lo + batch]
                    for i, (reply, error, start) in zip(some, asked([prompts[i] for i in some])):
                        p = prompts[i]
                        logs[i].append({"attempt": attempt, "prompt_sha256": hashlib.sha256(p.encode()).hexdigest(), "prompt_chars": len(p), "raw_response": reply, "error": error, "latency_ms": int(1000 * (time.monotonic() - start)), "at": pd.Timestamp.now("UTC")})
                        if error is not None or not good(reply):
                            again.append(i)
                left = again
            yield pdf.assign(calls=logs)

    return rows.mapInPandas(run, f"{kinds}, calls {CALLS}")


def outcomes(asked: DataFrame) -> DataFrame:
    """The last attempt of each row, parsed: ``judge_status, score, rationale, raw_response, retries_used``."""
    last = asked.withColumn("__c", F.element_at("calls", -1)).withColumn("raw_response", F.col("__c.raw_response"))
    parsed = last.withColumn("__p", judging.parsed(F.col("raw_response")))
    status = F.when(F.col("__c.error").isNotNull(), F.lit(judging.API_ERROR)).otherwise(F.col("__p.status"))
    return parsed.withColumns({"judge_status": status, "score": F.col("__p.score"), "rationale": F.col("__p.rationale"), "retries_used": F.size("calls") - 1}).drop("__c", "__p")


def call_log(asked: DataFrame, *keys: str) -> DataFrame:
    """A row for each attempt, with when and how long, and the status that its reply parses to."""
    rows = asked.select(*keys, F.explode("calls").alias("c")).select(*keys, "c.*")
    return rows.withColumn("parse_status", F.when(F.col("error").isNotNull(), F.lit(judging.API_ERROR)).otherwise(judging.parsed(F.col("raw_response"))["status"]))
