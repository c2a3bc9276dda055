"""Text functions as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
# Letters that are written alike, the elongation mark (dropped), and punctuation that comparisons ignore.
ALIKE, PLAIN = "أإآٱـ", "اااا"
PUNCTUATION = "[،؛؟.,;:!?٪٫٬\"'`()]+"


def empty(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + SPACE, ""), SPACE + "$", "")


def ws_tokens(c: Column) -> Column:
    """White-space tokens; none for null."""
    return F.filter(F.split(empty(c), SPACE), lambda x: x != "")


def word_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(empty(c)), F.lit(r"([\p{L}\p{N}]+)"), 1)


def normalize(c: Column) -> Column:
    """Letter variants merged, elongation dropped, white space collapsed."""
    return strip(F.regexp_replace(F.translate(empty(c), ALIKE, PLAIN), SPACE, " "))


def comparable(c: Column) -> Column:
    """``normalize`` without punctuation, lower-cased: the key of duplicate questions."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(normalize(c), PUNCTUATION, " "), SPACE, " ")))


def clip(c: Column, limit: int, ending: str = "") -> Column:
    """At most ``limit`` characters; cut text loses trailing white space and gains ``ending``."""
    c = empty(c)
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.left(c, F.lit(limit)), SPACE + "$", ""), F.lit(ending))).otherwise(c)


def estimated_tokens(chars: Column, per_token: int = 3) -> Column:
    return F.floor((chars + (per_token - 1)) / per_token).cast("long")


def squash(c: Column) -> Column:
    """White space collapsed and stripped: what error rates compare."""
    return strip(F.regexp_replace(empty(c), SPACE, " "))


def character_errors(reference: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """``(edits, length, rate)``; the rate is null for a blank reference and may exceed 1."""
    ref, hyp = squash(reference), squash(hypothesis)
    edits, size = F.levenshtein(ref, hyp), F.length(ref)
    return edits, size, F.when(size > 0, edits / size)


def first_banned(question: Column, phrases: list[str]) -> Column:
    """The first phrase whose normal form occurs in the question's, or null."""
    found = [F.when(F.contains(normalize(question), normalize(F.lit(p))), F.lit(p)) for p in phrases]
    return F.coalesce(*found, F.lit(None).cast("string"))
