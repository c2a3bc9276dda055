"""The runs: ingestion, question sets, retrieval, judging. DataFrames in, DataFrames out; a store keeps the artifacts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import blocks, bootstrap, context, fill, generation, gold, judge, merge, metrics, providers, qa, quality, retrieval, windows
from corpuslab.functions.text import ws_tokens
from corpuslab.plans.config import Settings
from corpuslab.sources import readers, writers

UNIT = {"unit_number": ("unit_title_ar",), "lesson_number": ("lesson_title_ar", "lesson_title_en")}


@dataclass
class Store:
    """Tables of a run under one folder. Each write is a new version, so readers of an older one go on; only finished versions count."""

    spark: SparkSession
    path: str

    def version(self, name: str) -> int:
        """The number of the newest finished version, or -1."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "v*/_SUCCESS")) or []
        return max((int(x.getPath().getParent().getName()[1:]) for x in done), default=-1)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v{self.version(name) + 1}")
        return self.get(name)

    def get(self, name: str) -> DataFrame | None:
        """The newest version, or None."""
        n = self.version(name)
        return self.spark.read.parquet(f"{self.path}/{name}/v{n}") if n >= 0 else None


def block_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of single blocks of filled pages."""
    return blocks.as_chunks(readers.blocks(fill.forward_fill(pages, UNIT)))


def block_stream(chunks: DataFrame) -> DataFrame:
    """Representation tokens of blocks as segments of their book's stream; ``other`` blocks stay out."""
    rows = chunks.where(~F.col("is_other"))
    return rows.select(F.col("book").alias("stream_id"), (F.col("page_number").cast("long") * (1 << 20) + F.col("block_index")).alias("seq"), "page_number", F.col("source_block_id").alias("block_id"), ws_tokens(blocks.representation()).alias("tokens"))


def ingest(settings: Settings, pages: DataFrame, store: Store) -> dict[str, DataFrame]:
    """Chunks of a system with what they cover, and the texts to embed.

    ``proposed`` merges blocks; ``b2`` cuts windows from the blocks' representation; ``b1``
    cuts windows from page texts (``book, page_number, text``) and knows pages only.
    """
    size, overlap = settings.windows.size, settings.windows.overlap
    if settings.system == "proposed":
        chunks = store.put("chunks", merge.in_order(merge.merge_blocks(block_chunks(pages))))
        cover = chunks.select("chunk_id", F.explode("source_block_coverage").alias("block_id", "coverage"))
        ranges = chunks.select("chunk_id", F.col("page_range")[0].alias("low"), F.col("page_range")[1].alias("high"))
        texts = chunks.where(~F.col("is_other")).select("chunk_id", "content_type", "page_range", blocks.representation(settings.representation.max_tokens, settings.representation.chars_per_token).alias("text"))
    else:
        if settings.system == "b2":
            segments = block_stream(block_chunks(pages))
        else:
            segments = pages.select(F.col("book").alias("stream_id"), F.col("page_number").cast("long").alias("seq"), "page_number", F.lit(None).cast("string").alias("block_id"), ws_tokens(F.col("text")).alias("tokens"))
        meta = pages.select(F.col("book").alias("stream_id"), "page_number")
        chunks = store.put("chunks", windows.records(windows.fixed_windows(segments, size, overlap), meta, settings.system).withColumn("content_type", F.lit("fixed_window")))
        named = chunks.select("stream_id", "window", "chunk_id")
        cover = windows.block_coverage(segments.where("block_id is not null"), size, overlap).join(named, ["stream_id", "window"]).select("chunk_id", "block_id", "coverage")
        ranges = chunks.select("chunk_id", F.col("first_page").alias("low"), F.col("last_page").alias("high"))
        texts = chunks.select("chunk_id", "content_type", "page_range", "text")
    return {"chunks": chunks, "coverage": store.put("coverage", cover), "page_ranges": store.put("page_ranges", ranges), "texts": store.put("texts", texts)}


def index(texts: DataFrame, provider: providers.Embed, store: Store) -> DataFrame:
    """Vectors of texts, upserted by id into the store's table."""
    fresh = providers.embed(texts, "chunk_id", "text", provider).where(F.size("values") > 0)
    old = store.get("vectors")
    return store.put("vectors", fresh if old is None else writers.upserted(old, fresh, "chunk_id"))


def question_set(settings: Settings, chunks: DataFrame, store: Store, strict: bool = True) -> dict[str, DataFrame]:
    """Tasks, candidates, rejections and the final set, by the stand-in generator; with ``strict`` unmet quotas raise."""
    flags = qa.eligibility(chunks, settings.selection.min_example_chars)
    tasks = qa.numbered(qa.select_tasks(flags, settings.selection), "task-%06d", "task_id", ["chunk_id"])
    first = lambda c: F.get(c, F.lit(0))
    figure = first(F.filter("diagrams", lambda d: F.trim(F.coalesce(d["description"], F.lit(""))) != ""))
    evidence = chunks.select("chunk_id", F.col("main_text_ar").alias("text"), F.coalesce(first("named_elements.definitions"), first("named_elements.vocabulary")["term_ar"], F.col("heading_ar")).alias("term"), first("math_expressions").alias("formula"), F.array_join(F.slice(F.coalesce(figure["labels"], F.array().cast("array<string>")), 1, 3), "، ").alias("labels"), figure["description"].alias("description"), F.array("content_type").alias("source_types"), "source_block_ids", "source_page_numbers")
    tasks = store.put("tasks", tasks.join(evidence, "chunk_id"))
    extra = tasks.select("task_id", "source_types", (F.coalesce("description", F.lit("")) != "").alias("described"), F.col("source_block_ids").alias("gold_source_block_ids"), F.col("source_page_numbers").alias("gold_page_numbers"))
    judged = store.put("candidates", qa.validate(qa.mock_candidates(tasks).join(extra, "task_id"), settings.validation))
    final = qa.finalize(judged.where("rejection_reason is null"), settings.selection, strict=strict)
    rejected = judged.where("rejection_reason is not null").select("candidate_id", "task_id", "question_type", "status", "rejection_reason", F.left("question", F.lit(200)).alias("question"))
    return {"tasks": tasks, "rejected": rejected, "dataset": store.put("dataset", final)}


def map_gold(settings: Settings, dataset: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
    """Relevant chunks of the system, by what its provenance supports."""
    q = dataset.withColumn("gold_page", F.col("gold_page_numbers")[0])
    g = settings.gold
    if settings.system == "proposed":
        return gold.by_block(q, made["coverage"], g.exact)
    if settings.system == "b2":
        return gold.by_coverage(q, made["coverage"], made["page_ranges"], g.ordinary, g.worked_example)
    return gold.by_page(q, made["page_ranges"])


#: From questions ``(qa_id, text)``, texts ``(chunk_id, text)`` and k to ``(qa_id, chunk_id, rank, score)``.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def dense(provider: providers.Embed, store: Store) -> Retriever:
    """Retrieval by the store's vectors, which are made where there are none; vectors of texts that are gone stay out."""

    def find(questions: DataFrame, texts: DataFrame, k: int) -> DataFrame:
        vectors = store.get("vectors")
        vectors = index(texts, provider, store) if vectors is None else vectors
        now = vectors.join(texts.select("chunk_id"), "chunk_id", "left_semi")
        return retrieval.dense_topk(providers.embed(questions, "qa_id", "text", provider), now, k)

    return find


def evaluate(settings: Settings, dataset: DataFrame, made: dict[str, DataFrame], targets: DataFrame, store: Store, retriever: Retriever = retrieval.lexical_topk) -> dict[str, DataFrame]:
    """Retrieval, metrics, contexts and stand-in answers of a system."""
    r = settings.retrieval
    hits = store.put("hits", retriever(dataset.select("qa_id", F.col("question").alias("text")), made["texts"].select("chunk_id", "text"), r.top_k))
    scores = metrics.question_scores(dataset.select("qa_id", "question_type"), hits, targets, r.reported)
    scores = scores.join(metrics.gold_recall(dataset, hits, targets), "qa_id")
    ctx = context.assemble(hits.join(made["texts"].select("chunk_id", "text"), "chunk_id"), r.context_budget)
    out = scores.join(ctx, "qa_id", "left").withColumns({"answer": context.mock_answer(F.col("context")), "system": F.lit(settings.system), "recall_name": F.lit(settings.recall_name)})
    # Fixed order of warnings: missing gold, unresolved targets, a cut context.
    warnings = F.array_compact(F.array(F.when(F.col("n_targets") == 0, "no gold"), F.when(F.size("unresolved") > 0, "unresolved targets"), F.when(F.coalesce("truncated", F.lit(False)), "context truncated")))
    records = store.put("records", out.withColumn("warnings", warnings))
    return {"records": records, "summary": metrics.summary(records, r.reported, "question_type"), "misses": metrics.misses(records, r.top_k)}


def generate(tasks: DataFrame, store: Store, provider: providers.Reply, force: bool = False) -> DataFrame:
    """Candidates of ``tasks(task_id, question_type, prompt)`` by a model; tasks that have a record, failed ones too, are not asked again unless ``force`` is set."""
    done = store.get("generated")
    asked = providers.ask(generation.unanswered(tasks, done, force).select("task_id", "question_type", "prompt"), "prompt", provider, 0)
    call = F.element_at("calls", -1)
    fresh = generation.candidates(asked.select("task_id", "question_type", call["raw_response"].alias("raw_response"), call["error"].alias("error")))
    if done is not None:
        fresh = fresh.unionByName(generation.unanswered(done, tasks) if force else done)
    return store.put("generated", fresh)


def judge_run(settings: Settings, dataset: DataFrame, records: DataFrame, store: Store, provider: providers.Reply = providers.mock_judge, limit: int | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Scores of all pending dimensions, merged into the store's ledger; finished ones are not asked again unless ``force`` is set. ``limit`` takes the first questions by id."""
    if limit is not None:
        dataset = quality.first(dataset, limit, "qa_id")
    items = records.join(dataset.select("qa_id", "question", F.col("answer").alias("reference")), "qa_id").select("qa_id", "system", "question", "reference", "context", "answer")
    work = judge.dimensions(items, settings.judge.mode, settings.judge.dimensions).withColumns({"prompt": judge.prompt(*[F.col(c) for c in ("question", "reference", "context", "answer")]), "skip": judge.skipped(F.col("answer"), F.col("context"))})
    old = store.get("ledger")
    if old is not None and not force:
        work = judge.pending(work, judge.ledger(old.withColumn("line", F.lit(0))))
    asked = store.put("calls", providers.ask(work.where("skip is null").select(*judge.KEY, "prompt"), "prompt", provider, settings.judge.max_retries))
    columns = [*judge.KEY, "judge_status", "score", "rationale", "raw_response", "retries_used"]
    fresh = providers.outcomes(asked).select(*columns)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("score", "double"), ("rationale", "string"), ("raw_response", "string"))]
    fresh = fresh.unionByName(work.where("skip is not null").select(*judge.KEY, F.col("skip").alias("judge_status"), *none, F.lit(0).alias("retries_used")))
    ledger = store.put("ledger", fresh if old is None else judge.merged(old, fresh))
    return {"ledger": ledger, "summary": judge.summary(ledger, ("system", "metric")), "calls": providers.call_log(asked, *judge.KEY)}


def recover_run(store: Store) -> DataFrame | None:
    """The store's ledger with parse errors judged again from their stored replies; no model is asked. None without a ledger."""
    ledger = store.get("ledger")
    return None if ledger is None else store.put("ledger", judge.recover(ledger))


def compare(settings: Settings, ledger: DataFrame) -> DataFrame:
    """Paired differences of the configured systems with bootstrap limits."""
    j = settings.judge
    return bootstrap.bootstrap(bootstrap.paired_differences(ledger, *j.pair), j.resamples, j.confidence, j.seed)
