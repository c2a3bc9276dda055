"""Questions from model replies: the evidence and prompt of a task, the reply's fields, the resumable run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import empty, strip

#: Fields of a chunk that a task keeps as they were; collections are never null.
SNAPSHOT = ("chunk_id", "page_number", "page_range", "content_type", "unit_number", "unit_title_ar", "lesson_number", "lesson_title_ar", "heading_ar", "main_text_ar", "math_expressions", "diagrams", "diagram_image_urls", "named_elements", "source_block_ids", "source_page_numbers", "source_block_coverage", "has_diagram", "has_math")
LISTS = ("math_expressions", "diagrams", "diagram_image_urls", "source_block_ids", "source_page_numbers")
# Statuses and defaults of a candidate.
GENERATED, FAILED, UNPARSED = "generated", "generation_failed", "parse_failed"
EASY, EXTRACTIVE = "easy", "extractive"


def snapshot(chunks: DataFrame) -> Column:
    """The chunk's fields at the time of the task, for validation and the final record; absent columns are null."""
    fields = []
    for name in SNAPSHOT:
        c = F.col(name) if name in chunks.columns else F.lit(None).cast("string")
        if name in LISTS and name in chunks.columns:
            c = F.coalesce(c, F.array().cast(chunks.schema[name].dataType))
        fields.append(c.alias(name))
    return F.struct(*fields)


def evidence(payload: Column) -> Column:
    """What a model is shown of a chunk: a line for each thing that it has."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(label), value))
    described = F.filter(payload["diagrams"], lambda d: (strip(empty(d["description"])) != "") | (F.size(F.coalesce(d["labels"], F.array().cast("array<string>"))) > 0))
    shown = F.transform(described, lambda d: F.struct(strip(empty(d["description"])).alias("description"), F.coalesce(d["labels"], F.array().cast("array<string>")).alias("labels")))
    place = strip(F.concat_ws(" ", empty(payload["lesson_number"]), empty(payload["lesson_title_ar"])))
    return F.concat_ws(
        "\n", line("Lesson: ", place), line("Content type: ", empty(payload["content_type"])), line("Heading: ", empty(payload["heading_ar"])),
        line("Text:\n", strip(empty(payload["main_text_ar"]))), F.when(F.size(payload["math_expressions"]) > 0, F.concat(F.lit("Formulas (LaTeX): "), F.to_json(payload["math_expressions"]))),
        F.when(F.size(shown) > 0, F.concat(F.lit("Diagram(s): "), F.to_json(shown))),
    )


def prompt(instruction: Column, payloads: Column, schema_hint: str) -> Column:
    """Instruction, evidence of each source (numbered if there are several), and the form of the answer."""
    one = F.size(payloads) <= 1
    blocks = F.transform(payloads, lambda p, i: F.concat(F.when(one, F.lit("--- Source ---\n")).otherwise(F.concat(F.lit("--- Source "), (i + 1).cast("string"), F.lit(" ---\n"))), evidence(p)))
    return F.concat_ws("\n\n", instruction, F.array_join(blocks, "\n\n"), F.lit(schema_hint))


def reply(raw: Column) -> Column:
    """``struct(tree, error)`` of a reply: fences at line ends are dropped anywhere; it must be a JSON object."""
    text = strip(empty(raw))
    bare = strip(F.regexp_replace(text, r"(?m)^```(?:json)?\s*|\s*```$", ""))
    tree = F.try_parse_json(bare)
    error = F.when(text == "", F.lit("empty response")).when(tree.isNull(), F.lit("json decode error")).when(~F.startswith(F.schema_of_variant(tree), F.lit("OBJECT")), F.lit("response was not a JSON object"))
    return F.struct(tree.alias("tree"), error.alias("error"))


def candidates(tasks: DataFrame, raw: str = "raw_response", failure: str = "error", keep: tuple[str, ...] = ()) -> DataFrame:
    """A candidate for each answered task (``task_id, question_type``, the columns ``keep``, a reply and a provider's error).

    Where a question comes from is the task's to say, never the model's; the model's own fields get
    defaults. Failed calls and replies that can't be read stay, with their status and reason.
    """
    rows = tasks.withColumn("__r", reply(F.col(raw)))
    good = F.col(failure).isNull() & F.col("__r.error").isNull()
    text = lambda path: F.when(good, F.try_variant_get("__r.tree", f"$.{path}", "string"))
    present = lambda path: F.try_variant_get("__r.tree", f"$.{path}", "variant").isNotNull()
    # what counts as true in a reply: anything but false, 0, null and the empty text, list or object
    flag = lambda path: F.when(good, F.coalesce(present(path) & ~F.coalesce(text(path), F.lit("")).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False)))
    return rows.select(
        F.concat("task_id", F.lit("-c0")).alias("candidate_id"), "task_id", "question_type", *keep,
        text("question_ar").alias("question"), text("question_en").alias("question_en"), text("answer_reference_ar").alias("answer"),
        F.when(good, F.coalesce(text("difficulty"), F.lit(EASY))).alias("difficulty"), F.when(good, F.coalesce(text("answer_mode"), F.lit(EXTRACTIVE))).alias("answer_mode"),
        flag("required_diagram").alias("required_diagram"), flag("required_formula").alias("required_formula"), F.col(raw).alias("raw_response"),
        F.coalesce(F.col(failure), F.col("__r.error")).alias("parse_error"),
        F.when(F.col(failure).isNotNull(), F.lit(FAILED)).when(F.col("__r.error").isNotNull(), F.lit(UNPARSED)).otherwise(F.lit(GENERATED)).alias("status"),
    )


def unanswered(tasks: DataFrame, done: DataFrame | None, force: bool = False) -> DataFrame:
    """Tasks without any record, failures included; ``force`` asks all again."""
    return tasks if force or done is None else tasks.join(done.select("task_id").distinct(), "task_id", "left_anti")


def final_records(picked: DataFrame, version: str = "v1") -> DataFrame:
    """The published columns of finalised candidates; collections are never null, the status says that they are validated."""
    lists = ("gold_source_block_ids", "gold_page_numbers", "source_types")
    keep = [F.coalesce(c, F.array().cast(picked.schema[c].dataType)).alias(c) for c in lists if c in picked.columns]
    rest = [c for c in ("question_en", "chunk_id", "lesson_number", "question_type") if c in picked.columns]
    return picked.select(
        "qa_id", F.lit(version).alias("dataset_version"), empty(F.col("question")).alias("question"), empty(F.col("answer")).alias("answer"), *rest, *keep,
        F.coalesce("difficulty", F.lit(EASY)).alias("difficulty"), F.coalesce("answer_mode", F.lit(EXTRACTIVE)).alias("answer_mode"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("required_diagram", "required_formula")], F.lit("validated").alias("status"),
    )
