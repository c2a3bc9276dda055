"""Judge replies: the stand-in judge, and the parsing of replies into a status and a score."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCORED, RECOVERED = "scored", "recovered"
PARSE_ERROR, INVALID, API_ERROR = "parse_error", "invalid_score", "api_error"
SKIP_ANSWER, SKIP_CONTEXT = "skipped_no_generated_answer", "skipped_no_context"
VALID, SKIPPED, FAILED = (SCORED, RECOVERED), (SKIP_ANSWER, SKIP_CONTEXT), (PARSE_ERROR, API_ERROR, INVALID)


def mock_score(prompt: Column) -> Column:
    """A score in [0, 1] by steps of a thousandth, from the prompt's digest."""
    return (F.conv(F.substring(F.sha2(prompt, 256), 1, 8), 16, 10).cast("long") % 1001) / 1000


def mock_confidence(prompt: Column) -> Column:
    return (F.conv(F.substring(F.sha2(prompt, 256), 9, 4), 16, 10).cast("long") % 1001) / 1000


def unfenced(reply: Column) -> Column:
    """A reply without code fences."""
    return F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?im)^\s*```(?:json)?\s*$|```(?:json)?", ""))


def bare(reply: str) -> str:
    """The same in Python, for providers."""
    return re.sub(r"(?im)^\s*```(?:json)?\s*$|```(?:json)?", "", reply).strip()


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _balanced(text: str | None) -> str | None:
    start = (text or "").find("{")
    depth = 0
    for m in _PIECE.finditer(text or "", start) if start >= 0 else ():
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return text[start : m.end()]
    return None


@F.pandas_udf(StringType())
def balanced_object(text: pd.Series) -> pd.Series:
    """The first balanced ``{...}``, with strings and escapes honoured: brackets are not regular, so this one is Python (in Arrow batches)."""
    return text.map(_balanced)


def flat_object(text: Column) -> Column:
    """The same for replies without nested objects, as an expression."""
    found = F.regexp_extract(text, r'(?s)^[^{]*(\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\})', 1)
    return F.when(found != "", found)


def parsed(reply: Column, objects=balanced_object) -> Column:
    """``struct(status, score, rationale)`` of a reply.

    Without an object, a plain ``"score": number`` in [0, 1] is recovered; a
    balanced object that isn't JSON is a parse error, and one without a number
    in [0, 1] an invalid score, never clamped. Numbers in strings count, ``true`` is 1.
    """
    text = unfenced(reply)
    obj = objects(text)
    # variants tell JSON from what only looks like it, and keep every kind of value
    tree = F.try_parse_json(obj)
    raw = F.lower(F.trim(F.try_variant_get(tree, "$.score", "string")))
    value = F.when(raw == "true", F.lit(1.0)).when(raw == "false", F.lit(0.0)).otherwise(raw.try_cast("double"))
    loose = F.regexp_extract(text, r'"score"\s*:\s*(\d+(?:\.\d+)?)', 1).try_cast("double")
    inside = lambda x: (x >= 0) & (x <= 1)
    status = (
        F.when(text == "", F.lit(PARSE_ERROR))
        .when(obj.isNull(), F.when(inside(loose), F.lit(RECOVERED)).otherwise(F.lit(PARSE_ERROR)))
        .when(tree.isNull(), F.lit(PARSE_ERROR))
        .when(inside(value) & ~F.isnan(value), F.lit(SCORED))
        .otherwise(F.lit(INVALID))
    )
    score = F.when(status == SCORED, value).when(status == RECOVERED, loose)
    return F.struct(status.alias("status"), score.alias("score"), F.when(status == SCORED, F.try_variant_get(tree, "$.rationale", "string")).alias("rationale"))
