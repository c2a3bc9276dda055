"""Registered queries of the library. Their DuckDB SQL is in :mod:`corpuslab.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import judging, text
from corpuslab.operators import blocks as B
from corpuslab.operators import bootstrap, context, fill, generation, gold, integrity, judge, merge, metrics, qa, quality, retrieval, windows
from corpuslab.plans.config import QUESTION_TYPES
from corpuslab.plans.oracles import ORACLES  # noqa: F401
from corpuslab.sources import adapters as A
from corpuslab.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- text


@query
def ws_token_counts(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.size(text.ws_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query
def word_token_counts(spark, sf):
    t = text.word_tokens(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query
def normalized_text(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("normal"), F.length(text.comparable(F.col("text"))).cast("long").alias("key_chars"))


# --- windows


@query
def fixed_windows(spark, sf):
    w = windows.fixed_windows(A.page_segments(spark, sf))
    return w.select("stream_id", "window", F.md5("text").alias("text_md5"), "n_tokens", "first_page", "last_page")


@query
def window_page_counts(spark, sf):
    return windows.page_counts(A.page_segments(spark, sf))


@query
def window_block_coverage(spark, sf):
    return windows.block_coverage(A.block_segments(spark, sf)).select("stream_id", "window", "block_id", "n_tokens", F.round("coverage", 9).alias("coverage"))


@query
def first_page_metadata(spark, sf):
    meta = A.pages(spark, sf).select(F.col("book").alias("stream_id"), "page_number", "unit_number", "lesson_number")
    out = windows.records(windows.fixed_windows(A.page_segments(spark, sf)), meta, "fx")
    return out.select("chunk_id", "stream_id", "first_page", "unit_number", "lesson_number", "n_tokens")


@query
def window_unions(spark, sf):
    """Addresses, standards and flags of the blocks that gave each window text."""
    k = F.col("page_number") + F.col("block_index")
    none = F.array().cast("array<string>")
    rows = A.blocks(spark, sf).select(
        F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("-b"), F.col("block_index").cast("string")).alias("block_id"), (F.col("page_number").cast("long") * (1 << 20) + F.col("block_index")).alias("position"),
        F.when(F.size("diagrams") > 0, F.array(F.concat(F.lit("u/"), F.col("page_number").cast("string")))).otherwise(none).alias("diagram_image_urls"), "named_elements.standards", (F.size("diagrams") > 0).alias("has_diagram"), (k % 5 == 0).alias("has_math"),
    )
    out = windows.block_unions(windows.block_coverage(A.block_segments(spark, sf)), rows)
    return out.select("stream_id", "window", F.array_join("diagram_image_urls", "|").alias("urls"), F.array_join("standards", "|").alias("standards"), "has_diagram", "has_math")


# --- pages and blocks


@query
def metadata_forward_fill(spark, sf):
    rows = A.pages(spark, sf).select("book", "page_number", "unit_number", "unit_title_ar")
    return fill.forward_fill(rows, {"unit_number": ("unit_title_ar",)})


@query
def block_ids(spark, sf):
    rows = A.blocks(spark, sf)
    args = F.col("unit_number"), F.col("lesson_number")
    place = F.col("page_number"), F.col("block_index")
    return rows.select(B.block_id(*args, *place).alias("block_id"), B.chunk_id(*args, F.col("content_type"), *place).alias("chunk_id"), B.page_of_block(B.block_id(*args, *place)).alias("page"))


@query
def chunk_confidence(spark, sf):
    rows = A.blocks(spark, sf)
    value = B.confidence(F.when(F.col("page_number") % 5 > 0, F.col("lesson_number")), F.col("unit_number"), F.col("text_ar"))
    return rows.select("page_number", "block_index", F.round(value, 6).alias("confidence"), (value < 0.6).alias("low"))


@query
def embedding_text(spark, sf):
    rows = B.as_chunks(A.blocks(spark, sf))
    return rows.select("page_number", "block_index", F.md5(B.representation()).alias("text_md5"))


@query
def embedding_text_truncated(spark, sf):
    rows = B.as_chunks(A.blocks(spark, sf))
    short = B.representation(40)
    return rows.select("page_number", "block_index", short.alias("text"), (F.length(B.representation(None)) > 120).alias("truncated"))


@query
def block_chunks(spark, sf):
    rows = B.as_chunks(A.blocks(spark, sf))
    return rows.select("chunk_id", "source_block_id", "content_type", "has_diagram", "has_math", "is_other", F.array_join("standards", "|").alias("standards"), F.array_join("math_expressions", "|").alias("math"))


@query
def merge_blocks_full(spark, sf):
    rows = merge.in_order(merge.merge_blocks(B.as_chunks(A.blocks(spark, sf))))
    return rows.select("book", "ordinal", "chunk_id", F.array_join("source_block_ids", "|").alias("blocks"), F.col("page_range")[0].alias("first_page"), F.col("page_range")[1].alias("last_page"), F.length("main_text_ar").cast("long").alias("n_chars"))


@query
def merge_blocks_simple(spark, sf):
    """All blocks with one key a lesson: without key drift, runs of continued blocks are islands."""
    rows = B.as_chunks(A.blocks(spark, sf)).withColumns({"content_type": F.lit("other"), "heading_ar": F.lit(None).cast("string")})
    out = merge.merge_plan(rows)
    members = F.transform(F.arrays_zip("pages", "blocks"), lambda m: F.concat(m["pages"].cast("string"), F.lit(":"), m["blocks"].cast("string")))
    return out.select("book", F.col("root_page").alias("page_number"), F.col("root_block").alias("block_index"), F.array_join(members, "|").alias("members"))


@query
def diagram_lookup(spark, sf):
    rows = A.blocks(spark, sf)
    d = rows.select("book", "page_number", "block_index", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")).withColumn("diagram_index", (F.col("position") % 2).cast("int"))
    manifest = A.pages(spark, sf).where("page_number % 2 = 0").select("book", "page_number", F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(0))).alias("line", "diagram_index")).withColumn("cloudinary_url", F.concat(F.lit("u/"), F.col("page_number").cast("string"), F.lit("/"), F.col("line").cast("string")))
    return B.image_links(d, manifest).select("book", "page_number", "block_index", F.array_join("urls", "|").alias("urls"))


@query
def bbox_normalise(spark, sf):
    d = A.blocks(spark, sf).select("book", "page_number", "block_index", F.explode("diagrams").alias("d")).select("book", "page_number", "block_index", "d.*")
    b = B.pixel_boxes(B.boxes(d).withColumns({"width": F.lit(1000), "height": F.lit(2000)}))
    return b.select("page_number", "block_index", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")], "left", "top", "right", "bottom")


@query
def index_metadata(spark, sf):
    rows = B.as_chunks(A.blocks(spark, sf)).withColumn("content_text", B.representation())
    m = writers.vector_metadata(rows, 200)
    return m.select("chunk_id", "page_range_start", "page_range_end", "unit_number", "lesson_number", "content_text_ar", "content_type", "has_diagram", F.array_join("problem_numbers", "|").alias("problem_numbers"), F.col("source_block_count").cast("int").alias("source_block_count"))


@query
def ordered_union(spark, sf):
    rows = A.blocks(spark, sf).select("page_number", "block_index", B.ordered_union("math_expressions", F.transform("problem_numbers", lambda p: p.cast("string")), F.array(F.lit("A"), F.lit("A"))).alias("u"))
    return rows.select("page_number", "block_index", F.array_join("u", "|").alias("united"))


@query
def block_table(spark, sf):
    """Pages with nested blocks, exploded: the scan that samplers and chunkers share."""
    rows = A.blocks(spark, sf)
    nested = rows.groupBy("book", "page_number").agg(F.array_sort(F.collect_list(F.struct("block_index", "content_type", "text_ar"))).alias("content_blocks"))
    out = readers.blocks(nested).where("content_type <> 'other'")
    return out.select("book", "page_number", "block_index", "content_type", F.length("text_ar").cast("long").alias("n_chars"))


@query
def sample_blocks(spark, sf):
    """A sampling operator: its limit is the feature."""
    rows = A.blocks(spark, sf).select(F.concat_ws("-", F.col("page_number").cast("string"), F.col("block_index").cast("string")).alias("block_id"), "content_type")
    return quality.sample(rows, 50, "block_id")


# --- retrieval


@query
def lexical_topk(spark, sf):
    return retrieval.lexical_topk(A.questions(spark, sf).select("qa_id", "text"), A.corpus(spark, sf).select("chunk_id", "text"))


@query
def dense_topk(spark, sf):
    rows = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("values"))
    q = rows.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "qa_id")
    return retrieval.dense_topk(q, rows)


def _scored(spark, sf) -> DataFrame:
    """Questions with metrics and recall over containment gold."""
    q, hits, g = A.questions(spark, sf).select("qa_id", "question_type"), lexical_topk(spark, sf), A.containment_gold(spark, sf)
    out = metrics.question_scores(q, hits, g)
    return out.join(metrics.gold_recall(q, hits, g).select("qa_id", "recall"), "qa_id")


@query
def lexical_hits(spark, sf):
    """Hits with their chunks; a missing chunk keeps the hit."""
    return lexical_topk(spark, sf).join(A.corpus(spark, sf).select("chunk_id", F.length("text").cast("long").alias("n_chars"), "lang"), "chunk_id", "left").select("qa_id", "rank", "chunk_id", "score", "n_chars", "lang")


@query
def retrieval_scores(spark, sf):
    return _scored(spark, sf).select("qa_id", "question_type", "first_rank", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "hit_at_1", "hit_at_5", F.round("recall", 6).alias("recall"))


@query
def retrieval_summary(spark, sf):
    return metrics.summary(_scored(spark, sf))


@query
def retrieval_summary_by_type(spark, sf):
    return metrics.summary(_scored(spark, sf), by="question_type")


@query
def retrieval_summary_full(spark, sf):
    """Also the contexts' tokens and how many questions have gold, types in canonical order."""
    q, g = A.questions(spark, sf), A.containment_gold(spark, sf)
    hits = lexical_topk(spark, sf)
    scores = metrics.question_scores(q.select("qa_id", "question_type"), hits, g).join(metrics.gold_recall(q, hits, g).select("qa_id", "recall", "n_targets"), "qa_id")
    contexts = context.assemble(hits.join(A.corpus(spark, sf).select("chunk_id", "text"), "chunk_id"), 600).select("qa_id", "token_count")
    return metrics.full_summary(scores.join(contexts, "qa_id", "left"), QUESTION_TYPES)


@query
def unexpected_types(spark, sf):
    return metrics.unexpected(_turns(spark, sf), QUESTION_TYPES)


@query
def report_integrity(spark, sf):
    """Two runs over the same questions with faults put in: missing and repeated ids, other labels, types that differ."""
    q = A.questions(spark, sf).select("qa_id", "question_type")
    named = lambda df, s: df.withColumn("system", F.lit(s))
    other = q.where("qa_id % 9 <> 0").withColumn("question_type", F.when(F.col("qa_id") % 11 != 0, F.col("question_type")))
    records = named(q, "proposed").unionByName(named(q.where("qa_id % 13 = 0"), "proposed")).unionByName(named(other, "b2")).unionByName(named(q.where("qa_id % 17 = 0"), "b9"))
    n = q.agg(F.count("*").alias("n"), F.lit(5).alias("top_k"))
    return integrity.retrieval_inputs(records, named(n, "proposed").unionByName(named(n, "b2")), ("proposed", "b2"))


@query
def judge_integrity(spark, sf):
    rows = A.judge_records(spark, sf).groupBy("system", "metric").agg(F.count("*").alias("n")).withColumn("context_budget", F.when(F.col("system") == "b2", 512).otherwise(256))
    return integrity.judge_inputs(rows, ("proposed", "b2", "b1"))


@query
def top_k_misses(spark, sf):
    return metrics.misses(_scored(spark, sf)).select("qa_id", "question_type")


@query
def gold_recall_targets(spark, sf):
    out = metrics.gold_recall(A.questions(spark, sf), lexical_topk(spark, sf), A.containment_gold(spark, sf))
    return out.select("qa_id", "n_targets", "n_covered", F.round("recall", 6).alias("recall"), F.array_join("unresolved", "|").alias("unresolved"))


def _two_systems(spark, sf) -> DataFrame:
    """The same questions by two rankings: all hits, and those of even chunks."""
    q, hits, g = A.questions(spark, sf).select("qa_id", "question_type"), lexical_topk(spark, sf), A.containment_gold(spark, sf)
    one = metrics.question_scores(q, hits, g).withColumn("system", F.lit("proposed"))
    return one.unionByName(metrics.question_scores(q, hits.where("chunk_id % 2 = 0"), g).withColumn("system", F.lit("b2")))


@query
def rank_outcomes(spark, sf):
    return metrics.rank_outcomes(_two_systems(spark, sf))


@query
def paired_questions(spark, sf):
    out = metrics.paired(_two_systems(spark, sf), ("proposed", "b2"))
    return out.select("qa_id", *[F.round(c, 6).alias(c) for c in ("proposed", "b2")])


@query
def unit_deltas(spark, sf):
    per = _two_systems(spark, sf).groupBy("system", "question_type").agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg(F.col("hit_at_5").cast("double")), 6).alias("hit_at_5"))
    return metrics.deltas(per, "proposed", "b2", metrics=("mrr", "hit_at_5"))


@query
def set_consistency(spark, sf):
    rows = _two_systems(spark, sf).select("system", "qa_id", "question_type")
    return quality.same_questions(rows.where("not (system = 'b2' and qa_id % 9 = 0)"))


# --- gold


def _gold_qa(spark, sf) -> DataFrame:
    """A question for each document: its first three lines as gold blocks."""
    d = F.col("doc_id").cast("string")
    rows = A.table(spark, sf, "documents").select(F.col("doc_id").alias("qa_id"), "source", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("p"), d, F.lit("-b"), i.cast("string"))).alias("gold_source_block_ids"), F.col("doc_id").cast("int").alias("gold_page"), F.array(F.col("doc_id").cast("int")).alias("gold_page_numbers"))
    kinds = F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]), (F.col("qa_id") % 5 + 1).cast("int"))
    return rows.withColumn("question_type", kinds)


def _window_chunks(spark, sf) -> tuple[DataFrame, DataFrame]:
    named = F.concat("stream_id", F.lit("-c"), F.col("window").cast("string")).alias("chunk_id")
    cover = windows.block_coverage(A.block_segments(spark, sf)).select(named, "block_id", "coverage")
    ranges = windows.fixed_windows(A.page_segments(spark, sf)).select(named, F.col("first_page").alias("low"), F.col("last_page").alias("high"))
    return cover, ranges


def _gold_columns(g: DataFrame) -> DataFrame:
    return g.select("qa_id", "target_id", "chunk_id", F.round("coverage", 6).alias("coverage"), "basis")


@query
def gold_block_match(spark, sf):
    return _gold_columns(gold.by_block(_gold_qa(spark, sf), _window_chunks(spark, sf)[0]))


@query
def gold_coverage_match(spark, sf):
    return _gold_columns(gold.by_coverage(_gold_qa(spark, sf), *_small_pages(spark, sf)).where("basis = 'coverage'"))


def _small_pages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Windows with the page ranges of single books: a range counts the pages that it holds."""
    cover, _ = _window_chunks(spark, sf)
    pages = windows.page_counts(A.page_segments(spark, sf)).select(F.concat("stream_id", F.lit("-c"), F.col("window").cast("string")).alias("chunk_id"), F.col("page_number").alias("low"), F.col("page_number").alias("high")).distinct()
    return cover, pages


@query
def gold_coverage_fallback(spark, sf):
    return _gold_columns(gold.by_coverage(_gold_qa(spark, sf), *_small_pages(spark, sf)).where("basis is null or basis <> 'coverage'"))


@query
def gold_page_overlap(spark, sf):
    return _gold_columns(gold.by_page(_gold_qa(spark, sf), _small_pages(spark, sf)[1])).select("qa_id", "target_id", "chunk_id", "basis")


@query
def gold_unmapped(spark, sf):
    return gold.unmapped(gold.by_block(_gold_qa(spark, sf), _window_chunks(spark, sf)[0]))


@query
def gold_status(spark, sf):
    q = _gold_qa(spark, sf)
    return gold.status(q, gold.by_block(q, _window_chunks(spark, sf)[0]))


# --- contexts


def _contexts(spark, sf) -> DataFrame:
    hits = lexical_topk(spark, sf).join(A.corpus(spark, sf).select("chunk_id", "text"), "chunk_id")
    return context.assemble(hits, 600)


@query
def context_assembly(spark, sf):
    return _contexts(spark, sf).select("qa_id", F.array_join(F.transform("chunk_ids", lambda c: c.cast("string")), "|").alias("chunk_ids"), "token_count", "truncated", "char_count", "estimated_tokens")


@query
def context_verification(spark, sf):
    c = _contexts(spark, sf).select("qa_id", "chunk_ids", "token_count", "truncated")
    odd = c.where("qa_id % 7 > 0").select("qa_id", F.when(F.col("qa_id") % 5 == 0, F.reverse("chunk_ids")).otherwise(F.col("chunk_ids")).alias("chunk_ids"), (F.col("token_count") + F.when(F.col("qa_id") % 3 == 0, 1).otherwise(0)).alias("token_count"), "truncated")
    return context.verify(c, odd)


@query
def mock_answer(spark, sf):
    return A.table(spark, sf, "conversations").select("conv_id", "turn", context.mock_answer(F.when(F.col("turn") % 4 > 0, F.col("text"))).alias("answer"))


# --- question sets


def _flags(spark, sf) -> DataFrame:
    return qa.eligibility(B.as_chunks(A.blocks(spark, sf)))


@query
def qa_eligibility(spark, sf):
    return _flags(spark, sf).select("chunk_id", *[f"is_{t}" for t in QUESTION_TYPES])


@query
def qa_selection(spark, sf):
    return qa.select_tasks(_flags(spark, sf)).select("question_type", "chunk_id", "lesson_number", "pass")


def _candidates(spark, sf) -> DataFrame:
    """A candidate for each chunk and type that it is eligible for, in one pass over the chunks."""
    chunks = qa.eligibility(B.as_chunks(A.blocks(spark, sf)))
    kinds = F.array_compact(F.array(*[F.when(F.col(f"is_{t}"), F.lit(t)) for t in QUESTION_TYPES]))
    figure = F.get("diagrams", F.lit(0))
    rows = chunks.select("chunk_id", "lesson_number", "content_type", F.col("main_text_ar").alias("text"), F.get("named_elements.definitions", F.lit(0)).alias("term"), F.get("math_expressions", F.lit(0)).alias("formula"), F.array_join(F.slice(F.coalesce(figure["labels"], F.array().cast("array<string>")), 1, 3), "، ").alias("labels"), figure["description"].alias("description"), F.explode(kinds).alias("question_type"))
    rows = rows.withColumn("task_id", F.concat_ws(":", "question_type", "chunk_id"))
    return qa.mock_candidates(rows, F.array("content_type").alias("source_types"), (F.coalesce("description", F.lit("")) != "").alias("described"))


@query
def qa_mock_candidates(spark, sf):
    return _candidates(spark, sf).select("candidate_id", "question_type", "question", F.md5("answer").alias("answer_md5"), "answer_mode", "required_diagram", "required_formula")


@query
def qa_validation(spark, sf):
    return qa.validate(_candidates(spark, sf)).select("candidate_id", "rejection_reason")


def _replies(spark, sf) -> DataFrame:
    """Conversation turns as answered tasks: fenced and plain objects, empty, broken and other replies, failed calls."""
    k = F.col("conv_id") + F.col("turn")
    task = F.concat_ws("-", F.lit("task"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    q = F.concat(F.lit('"question_ar": "Q '), F.md5("text"), F.lit('"'))
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("```json\n{"), q, F.lit(', "answer_reference_ar": "A", "difficulty": "hard", "required_formula": true}\n```')))
        .when(k % 6 == 1, F.concat(F.lit("{"), q, F.lit("}"))).when(k % 6 == 2, F.lit("  ")).when(k % 6 == 3, F.lit("no json")).when(k % 6 == 4, F.lit("[1, 2]"))
        .otherwise(F.concat(F.lit("{"), q, F.lit(', "answer_mode": "reasoning", "required_diagram": 1, "required_formula": false}')))
    )
    return A.table(spark, sf, "conversations").select(task.alias("task_id"), F.element_at(F.array(*[F.lit(t) for t in QUESTION_TYPES]), (k % 5 + 1).cast("int")).alias("question_type"), raw.alias("raw_response"), F.when(F.col("conv_id") % 7 == 0, F.lit("down")).alias("error"))


@query
def qa_reply_candidates(spark, sf):
    return generation.candidates(_replies(spark, sf)).select("candidate_id", "question_type", "question", "answer", "difficulty", "answer_mode", "required_diagram", "required_formula", "parse_error", "status")


@query
def qa_unanswered(spark, sf):
    """Tasks of a resumed run: those without any record, failed ones are not asked again."""
    tasks = _replies(spark, sf).select("task_id", "question_type")
    return generation.unanswered(tasks, generation.candidates(_replies(spark, sf).where("error is not null or question_type <> 'theorem_statement'")))


@query
def qa_evidence(spark, sf):
    """The prompt of each chunk's task, from its snapshot."""
    rows = B.as_chunks(A.blocks(spark, sf))
    payload = generation.snapshot(rows)
    text = generation.prompt(F.lit("Ask."), F.array(payload), "Answer with JSON.")
    return rows.select("page_number", "block_index", F.md5(F.regexp_extract(text, r"(?s)^(.*?)(?:\nFormulas|\nDiagram|\n\nAnswer with JSON)", 1)).alias("text_md5"), text.endswith("\n\nAnswer with JSON.").alias("ends"))


@query
def qa_rejections(spark, sf):
    """Conversation turns as candidates: every rule meets rows that break it."""
    return qa.validate(_turns(spark, sf)).where("rejection_reason is not null").select("candidate_id", "rejection_reason")


def _turns(spark, sf) -> DataFrame:
    k = F.col("conv_id") + F.col("turn")
    types = (*QUESTION_TYPES, "riddle")
    return A.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("candidate_id"), F.when(F.col("conv_id") % 13 == 0, F.concat(F.lit("في الصفحة "), "text")).otherwise(F.col("text")).alias("question"), F.concat(F.lit("ans "), F.col("turn").cast("string"), F.lit(" "), "role").alias("answer"),
        F.element_at(F.array(*[F.lit(t) for t in types]), (k % 6 + 1).cast("int")).alias("question_type"), F.when(F.col("conv_id") % 17 == 0, F.lit("parse_failed")).otherwise(F.lit("generated")).alias("status"),
        (k % 2 == 0).alias("required_formula"), (k % 4 != 1).alias("required_diagram"), F.when(k % 5 < 3, F.array(F.lit("theorem"), F.lit("example"))).otherwise(F.array(F.lit("other"))).alias("source_types"), (k % 3 == 0).alias("described"),
    )


@query
def qa_dedup(spark, sf):
    keyed = A.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("candidate_id"), text.comparable(F.col("text")).alias("key"))
    return keyed.groupBy(F.md5("key").alias("key_md5")).agg(F.min("candidate_id").alias("kept"), F.count("*").alias("n"))


@query
def qa_finalize(spark, sf):
    good = qa.validate(_candidates(spark, sf)).where("rejection_reason is null")
    return qa.finalize(good).select("qa_id", "candidate_id", "question_type", "lesson_number")


@query
def qa_value_counts(spark, sf):
    return qa.value_counts(B.as_chunks(A.blocks(spark, sf)), "content_type")


# --- judge


def _items(spark, sf) -> DataFrame:
    """Conversation turns as judge items."""
    rows = A.table(spark, sf, "conversations")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), F.when(F.col("turn") % 2 == 0, F.lit("proposed")).otherwise(F.lit("b2")).alias("system"), F.lit("What is said?").alias("question"), "role", F.col("role").alias("reference"), F.when(F.col("turn") % 3 > 0, F.col("text")).alias("context"), F.when(F.col("conv_id") % 4 > 0, F.col("text")).alias("answer"))


@query
def judge_dimensions(spark, sf):
    return judge.dimensions(_items(spark, sf)).select("qa_id", "system", "metric")


@query
def judge_mock_scores(spark, sf):
    return judge.mock_scores(_items(spark, sf), mode="generation").select("qa_id", "metric", "judge_status", "score")


@query
def judge_parse(spark, sf):
    return judge.parse_replies(A.judge_records(spark, sf).drop("judge_status", "score"), objects=judging.flat_object).select("line", "judge_status", "score")


@query
def judge_parse_balanced(spark, sf):
    """The same replies through the parser for nested objects."""
    return judge.parse_replies(A.judge_records(spark, sf).drop("judge_status", "score")).select("line", "judge_status", "score")


@query
def judge_ledger(spark, sf):
    return judge.ledger(A.judge_records(spark, sf)).select(*judge.KEY, "line", "judge_status", "score")


@query
def judge_pending(spark, sf):
    rows = A.judge_records(spark, sf)
    return judge.pending(rows.select(*judge.KEY).distinct(), judge.ledger(rows))


@query
def ledger_merge(spark, sf):
    rows = judge.ledger(A.judge_records(spark, sf)).select(*judge.KEY, "line", "score")
    return judge.merged(rows.where("line % 3 > 0"), rows.where("line % 2 = 0").withColumn("score", F.lit(1.0)))


@query
def judge_recover(spark, sf):
    return judge.recover(A.judge_records(spark, sf), judging.flat_object).select("line", "judge_status", "score")


@query
def judge_summary(spark, sf):
    return judge.summary(A.judge_records(spark, sf), ("system", "metric"))


@query
def judge_by_field(spark, sf):
    return judge.by_field(A.judge_records(spark, sf), "role")


@query
def judge_context_stats(spark, sf):
    return judge.context_stats(A.judge_records(spark, sf))


# --- comparison


def _mock_pairs(spark, sf) -> DataFrame:
    """Two systems' scores of each document by digests; some lack one."""
    d = A.table(spark, sf, "labels").select(F.col("doc_id").alias("qa_id"))
    rows = d.select("qa_id", F.explode(F.array(F.lit("proposed"), F.lit("b2"))).alias("system"), F.lit("context_recall").alias("metric"))
    score = judging.mock_score(F.concat_ws("|", F.col("qa_id").cast("string"), "system"))
    return rows.withColumn("judge_status", F.when((F.col("system") == "b2") & (F.col("qa_id") % 7 == 0), F.lit("api_error")).otherwise(F.lit("scored"))).withColumn("score", F.when(F.col("judge_status") == "scored", score))


@query
def paired_differences(spark, sf):
    return bootstrap.paired_differences(_mock_pairs(spark, sf), "proposed", "b2").withColumn("difference", F.round("difference", 6))


@query
def paired_bootstrap(spark, sf):
    return bootstrap.bootstrap(bootstrap.paired_differences(_mock_pairs(spark, sf), "proposed", "b2"))


def _cer(spark, sf) -> DataFrame:
    """Conversation turns against themselves with letters changed."""
    t = A.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("truth"), F.regexp_replace(F.translate("text", "eo", "o"), "th", "t").alias("reading"))
    return quality.cer_rows(t, "truth", "reading", ("conv_id", "turn", "role"))


@query
def cer_blocks(spark, sf):
    return _cer(spark, sf).select("conv_id", "turn", F.col("edits").cast("long").alias("edits"), F.col("length").cast("long").alias("length"), F.round("cer", 6).alias("cer"))


@query
def cer_summary(spark, sf):
    return quality.cer_summary(_cer(spark, sf), "role")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_summary_by_type(spark, sf_dir)
