"""Question sets: eligibility, selection, the stand-in generator, validation, the final pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuslab.functions.text import comparable, empty, first_banned, strip
from corpuslab.plans.config import DEFINITION_TYPES, EXAMPLE_TYPES, METHOD_CUES, QUESTION_TYPES, Selection, Validation


def eligibility(chunks: DataFrame, min_example_chars: int = 250) -> DataFrame:
    """A flag for each question type on chunks (``content_type, main_text_ar, math_expressions, diagrams, named_elements, has_diagram``)."""
    text, kind = strip(empty(F.col("main_text_ar"))), empty(F.col("content_type"))
    some = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    cue = F.lit(False)
    for c in METHOD_CUES:
        cue = cue | F.contains(text, F.lit(c))
    described = F.coalesce(F.exists("diagrams", lambda d: strip(empty(d["description"])) != ""), F.lit(False))
    flags = {
        "definition_recall": (text != "") & (kind.isin(*DEFINITION_TYPES) | some("named_elements.definitions") | some("named_elements.vocabulary")),
        "theorem_statement": kind == "theorem",
        "formula_retrieval": some("math_expressions"),
        "diagram_dependent": F.coalesce(F.col("has_diagram"), F.lit(False)) & described,
        "worked_example_reasoning": kind.isin(*EXAMPLE_TYPES) & (F.length(text) >= min_example_chars) & (some("math_expressions") | cue),
    }
    return chunks.withColumns({f"is_{k}": v for k, v in flags.items()})


def selection_reason(question_type: Column, chunk_type: Column, definitions: Column, vocabulary: Column) -> Column:
    named = F.when(F.size(definitions) > 0, F.lit("named_elements.definitions")).when(F.size(vocabulary) > 0, F.lit("named_elements.vocabulary"))
    by_type = F.concat(F.lit("content_type="), empty(chunk_type))
    return (
        F.when(question_type == "definition_recall", F.coalesce(named, by_type)).when(question_type == "theorem_statement", F.lit("content_type=theorem"))
        .when(question_type == "formula_retrieval", F.lit("has_math/math_expressions")).when(question_type == "diagram_dependent", F.lit("has_diagram+description"))
        .when(question_type == "worked_example_reasoning", by_type).otherwise(F.lit("unspecified"))
    )


def shuffled(seed: int, kind: str, key: Column) -> Column:
    """A reproducible order: the digest of seed, type and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(kind), key.cast("string")), 256)


def _capped(rows: DataFrame, order: Column, target: int, cap: int, lesson: str, blank_is_capped: bool) -> DataFrame:
    """The first ``target`` rows, those beyond a lesson's ``cap`` last.

    Ranks within lessons stop at the target, so only candidates for the pick are
    ranked over all lessons; ``limit`` on an order is a top-k that no task holds whole.
    """
    key = empty(F.col(lesson))
    rows = rows.withColumn("__o", order).withColumn("__k", key)
    rank = F.row_number().over(W.partitionBy("__k").orderBy("__o"))
    rows = rows.withColumn("__r", rank).where((F.col("__r") <= target))
    late = F.col("__r") > cap if blank_is_capped else (F.col("__k") != "") & (F.col("__r") > cap)
    return rows.withColumn("pass", F.when(late, 2).otherwise(1)).orderBy("pass", "__o").limit(target).drop("__o", "__k", "__r")


def select_tasks(chunks: DataFrame, knobs: Selection = Selection(), types: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """``(question_type, chunk_id, lesson_number, pass)``: for each type its share of chunks, none used twice, lessons capped while others last.

    Chunks have ``chunk_id``, ``lesson_number`` and the flags of :func:`eligibility`. Types are picked one
    after the other (a loop of five), as they share the chunks.
    """
    used, out = None, None
    for kind in types:
        eligible = chunks.where(F.col(f"is_{kind}")).select("chunk_id", "lesson_number")
        target = min(-(-int(knobs.quota * knobs.oversample * 1000) // (1000 * knobs.candidates_per_task)), eligible.count())
        cap = max(1, int(knobs.lesson_share * target))
        free = eligible if used is None else eligible.join(used, "chunk_id", "left_anti")
        picked = _capped(free, shuffled(knobs.seed, kind, F.col("chunk_id")), target, cap, "lesson_number", False).select(F.lit(kind).alias("question_type"), "chunk_id", "lesson_number", "pass")
        out = picked if out is None else out.unionByName(picked)
        used = out.select("chunk_id")
    return out


def numbered(rows: DataFrame, pattern: str, name: str, order: list[str], kind: str = "question_type") -> DataFrame:
    """Running ids over the canonical order of types; the set is small by its quotas."""
    place = F.array_position(F.array(*[F.lit(t) for t in QUESTION_TYPES]), F.col(kind))
    return rows.withColumn(name, F.format_string(pattern, F.row_number().over(W.orderBy(place, *order))))


def mock_question(question_type: Column, lesson: Column, tag: Column, term: Column, labels: Column) -> Column:
    """The stand-in generator's question. Its wording, which validation must accept."""
    ref = F.concat(F.lit("(مرجع "), tag, F.lit(")"))
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    return (
        F.when(question_type == "definition_recall", say("ما تعريف ", term, " في الدرس ", lesson, "؟ ", ref)).when(question_type == "theorem_statement", say("اذكر نص النظرية الواردة في الدرس ", lesson, ". ", ref))
        .when(question_type == "formula_retrieval", say("اكتب الصيغة الرياضية الواردة في الدرس ", lesson, ". ", ref))
        .when(question_type == "diagram_dependent", say("بالاعتماد على الشكل الموضح (", labels, ") في الدرس ", lesson, "، صف العلاقة الهندسية المطلوبة. ", ref))
        .when(question_type == "worked_example_reasoning", say("اشرح خطوات الحل المتّبعة في المثال في الدرس ", lesson, ". ", ref)).otherwise(say("سؤال حول الدرس ", lesson, ". ", ref))
    )


def mock_candidates(tasks: DataFrame, *more: Column) -> DataFrame:
    """A candidate for each task (``task_id, question_type, chunk_id, lesson_number, text, term, formula, labels, description``), decided by the task alone, with ``more`` columns of the task."""
    kind, text = F.col("question_type"), empty(F.col("text"))
    body = F.when(kind == "formula_retrieval", F.concat(F.lit("الصيغة: "), empty(F.col("formula")), F.lit(". "), text)).when(kind == "diagram_dependent", F.coalesce(F.when(strip(empty(F.col("description"))) != "", strip(F.col("description"))), text)).otherwise(text)
    return tasks.select(
        F.concat("task_id", F.lit("-c0")).alias("candidate_id"), "task_id", "question_type", "chunk_id", "lesson_number",
        mock_question(kind, empty(F.col("lesson_number")), F.col("chunk_id").cast("string"), F.coalesce("term", F.lit("المفهوم")), empty(F.col("labels"))).alias("question"),
        F.left(strip(body), F.lit(1000)).alias("answer"), F.lit("easy").alias("difficulty"),
        F.when(kind == "worked_example_reasoning", F.lit("reasoning")).otherwise(F.lit("extractive")).alias("answer_mode"),
        (kind == "diagram_dependent").alias("required_diagram"), (kind == "formula_retrieval").alias("required_formula"), F.lit("generated").alias("status"), *more,
    )


def rejection(rules: Validation = Validation()) -> Column:
    """The first rule that a candidate breaks, or null; duplicates are judged afterwards.

    Reads ``status, question, answer, question_type, required_formula, required_diagram, source_types, described``.
    """
    q, a, kind = strip(empty(F.col("question"))), strip(empty(F.col("answer"))), F.col("question_type")
    off = lambda c, lo, hi: ~F.length(c).between(lo, hi)
    sources = F.coalesce("source_types", F.array().cast("array<string>"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    banned = first_banned(q, list(rules.banned))
    # The reasons' wording.
    return (
        F.when(empty(F.col("status")) != "generated", F.concat(F.lit("non-generated status: "), F.coalesce("status", F.lit("None"))))
        .when((q == "") | (a == ""), F.lit("missing question or answer"))
        .when(~F.coalesce(kind.isin(*QUESTION_TYPES), F.lit(False)), F.concat(F.lit("invalid question_type: "), F.coalesce(kind, F.lit("None"))))
        .when(off(q, rules.min_question, rules.max_question), F.concat(F.lit("question length "), F.length(q).cast("string"), F.lit(" out of bounds")))
        .when(off(a, rules.min_answer, rules.max_answer), F.concat(F.lit("answer length "), F.length(a).cast("string"), F.lit(" out of bounds")))
        .when(banned.isNotNull(), F.concat(F.lit("banned phrase: "), banned))
        .when((kind == "formula_retrieval") & ~flag("required_formula"), F.lit("formula question without required_formula=true"))
        .when((kind == "diagram_dependent") & ~flag("required_diagram"), F.lit("diagram question without required_diagram=true"))
        .when((kind == "theorem_statement") & ~F.array_contains(sources, "theorem"), F.lit("theorem question not sourced from a theorem chunk"))
        .when((kind == "diagram_dependent") & ~flag("described"), F.lit("diagram question lacks a diagram description in source payload"))
        .when((kind == "worked_example_reasoning") & ~F.arrays_overlap(sources, F.array(*[F.lit(t) for t in EXAMPLE_TYPES])), F.lit("worked example not sourced from example/worked_example/explore"))
    )


def validate(candidates: DataFrame, rules: Validation = Validation()) -> DataFrame:
    """Candidates with ``rejection_reason``; of equal questions that pass the rules the one of smallest id stays."""
    # questions meet by a digest of 128 bits, not by their texts
    rows = candidates.withColumn("__reason", rejection(rules)).withColumn("__key", F.unhex(F.md5(comparable(F.col("question")))))
    first = rows.where("__reason is null").groupBy("__key").agg(F.min("candidate_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    rows = rows.join(first, "__key", "left")
    twice = F.when(F.col("__reason").isNull() & (F.col("candidate_id") != F.col("__first")), F.concat(F.lit("duplicate of "), F.col("__first").cast("string")))
    return rows.withColumn("rejection_reason", F.coalesce("__reason", twice)).drop("__reason", "__key", "__first")


def finalize(candidates: DataFrame, knobs: Selection = Selection(), types: tuple[str, ...] = QUESTION_TYPES, strict: bool = False) -> DataFrame:
    """Up to ``quota`` candidates of each type, lessons capped (blank ones too), and running ids.

    At most ``per_chunk`` candidates of a chunk come into question, first in the shuffled order. With
    ``strict`` a type that falls short raises before anything is returned.
    """
    kind = F.col("question_type")
    rows = candidates.where(kind.isin(*types)).withColumn("__o", F.sha2(F.concat_ws("|", F.lit(str(knobs.seed)), kind, F.col("candidate_id").cast("string")), 256)).withColumn("__k", empty(F.col("lesson_number")))
    rank = lambda *by, order: F.row_number().over(W.partitionBy("question_type", *by).orderBy(*order))
    rows = rows.withColumn("__c", rank("chunk_id", order=["__o"])).where(F.col("__c") <= knobs.per_chunk)
    # all types at once; each rank is a group limit, so a task hands on a quota of each group at most
    rows = rows.withColumn("__r", rank("__k", order=["__o"])).where(F.col("__r") <= knobs.quota)
    rows = rows.withColumn("__late", F.col("__r") > -(-int(knobs.lesson_share * knobs.quota * 1000) // 1000))
    out = rows.withColumn("__n", rank(order=["__late", "__o"])).where(F.col("__n") <= knobs.quota).drop("__o", "__k", "__c", "__r", "__late", "__n")
    if strict:
        have = {r[0]: r[1] for r in out.groupBy("question_type").count().collect()}
        short = {t: knobs.quota - have.get(t, 0) for t in types if have.get(t, 0) < knobs.quota}
        if short:
            raise ValueError(f"too few candidates: {short}")
    return numbered(out, "qa-%04d", "qa_id", ["candidate_id"])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts of values, lists exploded, most frequent first."""
    from pyspark.sql.types import ArrayType

    value = F.explode(column) if isinstance(rows.schema[column].dataType, ArrayType) else F.col(column)
    return rows.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value"))
