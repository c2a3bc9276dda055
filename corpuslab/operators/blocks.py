"""Blocks as chunks: ids, confidence, representation text, boxes, image links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import SPACE, empty, strip


def _place(unit: Column, lesson: Column, semester: int) -> Column:
    lesson = F.when(empty(lesson) == "", F.lit("X")).otherwise(F.replace(lesson, F.lit("."), F.lit("-")))
    return F.concat(F.lit(f"s{semester}-u"), F.coalesce(unit.cast("string"), F.lit("X")), F.lit("-l"), lesson)


def block_id(unit: Column, lesson: Column, page: Column, index: Column, semester: int = 2) -> Column:
    return F.concat(_place(unit, lesson, semester), F.lit("-p"), page.cast("string"), F.lit("-b"), index.cast("string"))


def chunk_id(unit: Column, lesson: Column, kind: Column, page: Column, index: Column, semester: int = 2) -> Column:
    return F.concat(_place(unit, lesson, semester), F.lit("-"), kind, F.lit("-p"), page.cast("string"), F.lit("-b"), index.cast("string"))


def page_of_block(block: Column) -> Column:
    """The page that a block id names, or null."""
    return F.regexp_extract(block, r"-p(\d+)-b\d+$", 1).try_cast("int")


def confidence(lesson: Column, unit: Column, text: Column) -> Column:
    """1, less a fifth without a lesson, a fifth without a unit, two fifths without a text or a fifth with a short one; not below 0."""
    size = F.length(empty(text))
    value = F.lit(1.0) - F.when(empty(lesson) == "", 0.2).otherwise(0.0) - F.when(unit.isNull(), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), value - F.when(size == 0, 0.4).when(size < 50, 0.2).otherwise(0.0))


def as_chunks(blocks: DataFrame, semester: int = 2) -> DataFrame:
    """A chunk for each block: 26 columns, collections never null, a single block that covers itself."""
    kind = F.coalesce(F.when(F.col("content_type") != "", F.col("content_type")), F.lit("other"))
    own = block_id(F.col("unit_number"), F.col("lesson_number"), F.col("page_number"), F.col("block_index"), semester)
    some = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    named = F.col("named_elements")
    distinct = lambda c, t: F.array_distinct(F.coalesce(named[c], F.array().cast(t)))
    vocabulary = "array<struct<term_ar: string, term_en: string>>"
    elements = F.struct(distinct("theorems", "array<string>").alias("theorems"), distinct("definitions", "array<string>").alias("definitions"), distinct("vocabulary", vocabulary).alias("vocabulary"), distinct("standards", "array<string>").alias("standards"))
    diagrams = blocks.schema["diagrams"].dataType.simpleString()
    math, pictures = some("math_expressions", "array<string>"), some("diagrams", diagrams)
    return blocks.select(
        *[c for c in ("book",) if c in blocks.columns],
        chunk_id(F.col("unit_number"), F.col("lesson_number"), kind, F.col("page_number"), F.col("block_index"), semester).alias("chunk_id"),
        own.alias("source_block_id"), F.array(own).alias("source_block_ids"), F.array("page_number").alias("source_page_numbers"), F.create_map(own, F.lit(1.0)).alias("source_block_coverage"),
        "page_number", F.array("page_number", "page_number").alias("page_range"), kind.alias("content_type"), "unit_number", "unit_title_ar", "lesson_number", "lesson_title_ar", "lesson_title_en", "standard", "heading_ar",
        some("problem_numbers", "array<int>").alias("problem_numbers"), empty(F.col("text_ar")).alias("main_text_ar"), math.alias("math_expressions"), pictures.alias("diagrams"), F.array().cast("array<string>").alias("diagram_image_urls"), elements.alias("named_elements"),
        (F.size(pictures) > 0).alias("has_diagram"), (F.size(math) > 0).alias("has_math"), elements["standards"].alias("standards"), (kind == "other").alias("is_other"),
        confidence(F.col("lesson_number"), F.col("unit_number"), F.col("text_ar")).alias("extraction_confidence"),
        F.coalesce("continues_to_next_page", F.lit(False)).alias("continues"), F.coalesce("continued_from_prev_page", F.lit(False)).alias("continued"), "block_index",
    )


def representation(max_tokens: int | None = 1800, per_token: int = 3) -> Column:
    """The text that stands for a chunk: titles, heading, text, one line for each formula and diagram; cut at the token estimate unless that is None."""
    label = lambda c, word: F.when(empty(F.col(c)) != "", F.concat(F.lit(word), F.col(c)))
    # The labels of the lines.
    head = F.array(label("unit_title_ar", "الوحدة: "), label("lesson_title_ar", "الدرس: "), label("lesson_title_en", "Lesson: "), label("heading_ar", ""), label("main_text_ar", ""))
    math = F.transform(F.filter(F.coalesce("math_expressions", F.array().cast("array<string>")), lambda x: empty(x) != ""), lambda x: F.concat(F.lit("المعادلة: "), x))
    figure = lambda d: F.concat(F.lit("[شكل هندسي: "), empty(d["description"]), F.lit(". التسميات: "), F.array_join(F.coalesce(d["labels"], F.array().cast("array<string>")), "، "), F.lit("]"))
    text = F.array_join(F.concat(F.array_compact(head), math, F.coalesce(F.transform("diagrams", figure), F.array().cast("array<string>"))), "\n")
    if max_tokens is None:
        return text
    most = max_tokens * per_token
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.left(text, F.lit(most)), SPACE + "$", ""), F.lit("…"))).otherwise(text)


def context_text(stored: Column) -> Column:
    """The text of a retrieved chunk: its untruncated representation if it has text and any structure, its text, or what the index stored."""
    plain = F.col("main_text_ar")
    rich = (F.size("math_expressions") > 0) | (F.size("diagrams") > 0) | (empty(F.col("unit_title_ar")) != "") | (empty(F.col("lesson_title_ar")) != "") | (empty(F.col("heading_ar")) != "")
    return F.when(strip(empty(plain)) == "", empty(stored)).when(rich, representation(None)).otherwise(plain)


def image_links(diagrams: DataFrame, manifest: DataFrame) -> DataFrame:
    """Links of each block in order of its diagrams, each once; of manifest rows of one index the last wins, null indices have none."""
    last = manifest.where("diagram_index is not null and cloudinary_url is not null").groupBy("book", "page_number", "diagram_index").agg(F.max_by("cloudinary_url", "line").alias("url"))
    found = diagrams.join(last, ["book", "page_number", "diagram_index"], "left")
    urls = F.transform(F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("position", "url")))), lambda x: x["url"])
    return found.groupBy("book", "page_number", "block_index").agg(F.array_distinct(urls).alias("urls"))


def boxes(diagrams: DataFrame) -> DataFrame:
    """Boxes as shares of the page: ``box_2d`` is (y1, x1, y2, x2) by thousandths, clamped; four numbers are required, empty boxes go."""
    part = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("box_2d", F.lit(i)) / 1000))
    whole = (F.size("box_2d") == 4) & ~F.exists("box_2d", lambda x: x.isNull())
    out = diagrams.where(whole).select(*[c for c in diagrams.columns if c != "box_2d"], part(1).alias("x1"), part(0).alias("y1"), part(3).alias("x2"), part(2).alias("y2"))
    return out.where("x1 < x2 and y1 < y2")


def pixel_boxes(found: DataFrame, pad: int = 12) -> DataFrame:
    """Boxes in pixels of ``width`` and ``height``, padded and clamped; collapsed ones go."""
    low = lambda c, side: F.greatest(F.lit(0), F.floor(F.col(c) * F.col(side)).cast("int") - pad)
    high = lambda c, side: F.least(F.col(side), F.floor(F.col(c) * F.col(side)).cast("int") + pad)
    out = found.withColumns({"left": low("x1", "width"), "top": low("y1", "height"), "right": high("x2", "width"), "bottom": high("y2", "height")})
    return out.where("left < right and top < bottom")


def ordered_union(*lists: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(F.concat(*lists))
