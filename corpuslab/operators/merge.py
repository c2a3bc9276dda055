"""Blocks that continue across pages, merged into one chunk.

The only state is what is open in a lesson, so lessons are independent groups. A
chunk's place in the output is that of the block that closed it; ``(leftover,
seq, sub)`` gives the order of all lessons together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLAN = "book string, lesson_key string, root_page int, root_block int, pages array<int>, blocks array<int>, leftover int, seq long, sub int"


@dataclass
class _Open:
    kind: tuple
    members: list = field(default_factory=list)


def _lesson(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which blocks form a chunk, and when it closed."""
    pdf = pdf.sort_values(["page_number", "block_index"])
    running: dict[tuple, _Open] = {}
    carry: tuple | None = None
    done = []

    def close(chunk: _Open, leftover: int, seq: int, sub: int) -> None:
        done.append((chunk.members, leftover, seq, sub))

    for page, index, kind, heading, onward, onto, seq in zip(*(pdf[c] for c in ("page_number", "block_index", "content_type", "heading_ar", "continues", "continued", "seq"))):
        name = (kind, heading if isinstance(heading, str) else None)
        target = (name if name in running else carry if carry in running else None) if onto else None
        if target is not None:
            running[target].members.append((page, index))
            if not onward:
                close(running.pop(target), 0, seq, 1)
                carry = None
            continue
        if not onto and name in running:
            close(running.pop(name), 0, seq, 0)
        chunk = _Open(name, [(page, index)])
        if onward:
            running[name] = chunk
            carry = name
        else:
            close(chunk, 0, seq, 1)
    for n, chunk in enumerate(running.values()):
        close(chunk, 1, int(pdf["seq"].iloc[-1]) if len(pdf) else 0, n)
    first = pdf.iloc[0]
    return pd.DataFrame(
        [(first["book"], first["lesson_key"], m[0][0], m[0][1], [p for p, _ in m], [b for _, b in m], left, seq, sub) for m, left, seq, sub in done],
        columns=["book", "lesson_key", "root_page", "root_block", "pages", "blocks", "leftover", "seq", "sub"],
    )


def merge_plan(blocks: DataFrame) -> DataFrame:
    """The members of each chunk: only keys and flags travel to the state machine, not texts."""
    keys = blocks.select("book", F.coalesce(F.concat(F.lit("="), "lesson_number"), F.lit("")).alias("lesson_key"), "page_number", "block_index", "content_type", "heading_ar", "continues", "continued", (F.col("page_number").cast("long") * (1 << 20) + F.col("block_index")).alias("seq"))
    return keys.groupBy("book", "lesson_key").applyInPandas(_lesson, PLAN)


def merge_blocks(chunks: DataFrame) -> DataFrame:
    """Merged chunks of single-block ``chunks``: texts joined by a blank line, lists united in order, flags ORed, everything else from the first block."""
    plan = merge_plan(chunks)
    member = plan.select("book", "root_page", "root_block", "leftover", "seq", "sub", F.posexplode(F.arrays_zip("pages", "blocks")).alias("n", "m")).select("book", "root_page", "root_block", "leftover", "seq", "sub", "n", F.col("m.pages").alias("page_number"), F.col("m.blocks").alias("block_index"))
    rows = member.join(chunks, ["book", "page_number", "block_index"])
    joined = ("math_expressions", "diagrams", "diagram_image_urls", "standards", "problem_numbers", "source_block_ids", "source_page_numbers")
    named = ("theorems", "definitions", "vocabulary", "standards")
    whole = F.struct("n", F.struct(*[c for c in chunks.columns if c not in ("page_number", "block_index", "book")], "page_number").alias("c"))
    parts = F.transform(F.array_sort(F.collect_list(whole), lambda a, b: a["n"] - b["n"]), lambda x: x["c"])
    out = rows.groupBy("book", "root_page", "root_block", "leftover", "seq", "sub").agg(parts.alias("p"))
    first = F.col("p")[0]
    all_ = lambda f: F.flatten(F.transform("p", f))
    of_named = lambda c: lambda x: x["named_elements"][c]
    of = lambda c: lambda x: x[c]
    lists = {c: F.array_distinct(all_(of(c))) for c in joined if c in chunks.columns}
    # the first block's own lists keep their repeats
    lists |= {c: F.when(F.size("p") == 1, first[c]).otherwise(lists[c]) for c in ("math_expressions", "diagrams") if c in chunks.columns}
    text = F.regexp_replace(F.array_join(F.filter(F.transform("p", lambda x: x["main_text_ar"]), lambda t: t != ""), "\n\n"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    columns = {c: first[c] for c in chunks.columns if c not in ("page_number", "block_index", "book")}
    columns |= lists | {"main_text_ar": F.when(F.size("p") == 1, first["main_text_ar"]).otherwise(text), "page_range": F.array(first["page_number"], F.element_at("p", -1)["page_number"])}
    columns |= {c: F.exists("p", of(c)) for c in ("has_diagram", "has_math") if c in chunks.columns}
    if "named_elements" in chunks.columns:
        columns["named_elements"] = F.struct(*[F.array_distinct(all_(of_named(c))).alias(c) for c in named])
    if "source_block_coverage" in chunks.columns:
        columns["source_block_coverage"] = F.map_from_entries(F.transform(columns["source_block_ids"], lambda b: F.struct(b, F.lit(1.0))))
    return out.select("book", F.col("root_page").alias("page_number"), F.col("root_block").alias("block_index"), "leftover", "seq", "sub", *[v.alias(c) for c, v in columns.items()])


#: Closing places that are counted together before chunks are numbered.
STRIP = 1 << 26


def in_order(merged: DataFrame) -> DataFrame:
    """Chunks with their ordinal in the closing order of their book: counts of strips carry the offsets, so a long book isn't one task."""
    rows = merged.withColumn("__strip", F.floor(F.col("seq") / STRIP))
    strips = rows.groupBy("book", "leftover", "__strip").agg(F.count("*").alias("__n"))
    before = W.partitionBy("book").orderBy("leftover", "__strip").rowsBetween(W.unboundedPreceding, -1)
    strips = strips.select("book", "leftover", "__strip", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    place = F.row_number().over(W.partitionBy("book", "leftover", "__strip").orderBy("seq", "sub", "page_number", "block_index"))
    return rows.join(strips, ["book", "leftover", "__strip"]).withColumn("ordinal", (F.col("__off") + place - 1).cast("long")).drop("__strip", "__off")
