"""Hand-computed cases of the kernels."""

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import judging, text
from corpuslab.operators import blocks, bootstrap, context, fill, generation, gold, integrity, judge, merge, metrics, qa, quality, retrieval, windows
from corpuslab.plans.config import Settings, as_dict, override


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def tokens(spark, pages):
    return spark.createDataFrame([("s", i, p, f"B{b}", t) for i, (p, b, t) in enumerate(pages)], "stream_id string, seq long, page_number int, block_id string, tokens array<string>")


def test_windows_and_coverage(spark):
    t = [f"t{i}" for i in range(12)]
    df = tokens(spark, [(1, 0, t[:4]), (2, 0, t[4:6]), (2, 1, t[6:9]), (3, 1, t[9:])])
    w = rows(windows.fixed_windows(df, 5, 2).select("window", "first_page", "last_page", "n_tokens", "text"), "window")
    assert [x[:4] for x in w] == [(0, 1, 2, 5), (1, 1, 2, 5), (2, 2, 3, 5), (3, 3, 3, 3)]
    assert w[1][4] == "t3 t4 t5 t6 t7"
    c = {(r[0], r[1]): r[2] for r in rows(windows.block_coverage(df, 5, 2).select("window", "block_id", "coverage"))}
    assert c == {(0, "B0"): 5 / 6, (1, "B0"): 3 / 6, (1, "B1"): 2 / 6, (2, "B1"): 5 / 6, (3, "B1"): 3 / 6}


@pytest.mark.parametrize(("n", "expected"), [(0, 0), (5, 1), (6, 2)])
def test_window_edges(spark, n, expected):
    df = tokens(spark, [(1, 0, ["x"] * n), (2, 0, [])])
    assert windows.fixed_windows(df, 5, 2).count() == expected


def test_forward_fill(spark):
    df = spark.createDataFrame([("b", 1, 1, "A"), ("b", 2, None, "stray"), ("b", 3, 2, None), ("b", 4, None, None), ("b", 5, 0, "zero")], "book string, page_number int, n int, title string")
    out = fill.forward_fill(df, {"n": ("title",)})
    assert rows(out.select("n", "title"), "page_number") == [(1, "A"), (1, "A"), (2, None), (2, None), (2, None)]
    assert rows(fill.forward_fill(out, {"n": ("title",)}), "page_number") == rows(out, "page_number")


def test_forward_fill_over_strips(spark):
    """Strips of any length give what one window over the book gives; groups are independent, null books and pages are kept."""
    data = [(book, p, p if p % 7 == 3 else 0, f"t{p}", f"{p}.1" if p % 11 == 5 else "", f"l{p}") for book in ("a", "b", None) for p in range(-3, 40)]
    data += [("a", None, None, "first", None, "first"), ("c", 5, None, "x", None, None)]
    df = spark.createDataFrame(data, "book string, page_number int, n int, title string, lesson string, name string")
    groups = {"n": ("title",), "lesson": ("name",)}
    want = []
    for book in ("a", "b", "c", None):
        last = {0: None, 1: None}
        for b, p, n, t, m, l in sorted((d for d in data if d[0] == book), key=lambda d: (d[1] is not None, d[1] or 0)):
            own = ((n, t), (m, l))
            for i in (0, 1):
                last[i] = own[i] if own[i][0] else last[i]
            want.append((b, p, *(last[0] or own[0]), *(last[1] or own[1])))
    for strip in (1, 4, 4096):
        out = fill.forward_fill(df, groups, strip=strip)
        assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


BLOCK = "book string, lesson_number string, page_number int, block_index int, content_type string, heading_ar string, continues boolean, continued boolean"


def plan(spark, data):
    out = merge.merge_plan(spark.createDataFrame([("b", *d) for d in data], BLOCK))
    return [(r["pages"], r["blocks"]) for r in out.orderBy("leftover", "seq", "sub").collect()]


def test_merge_across_pages(spark):
    data = [("1", 1, 0, "example", "m1", True, False), ("1", 1, 1, "exercise", "x", False, False), ("1", 2, 0, "example", "m1", False, True)]
    assert plan(spark, data) == [([1], [1]), ([1, 2], [0, 0])]


def test_merge_key_drift_orphan_and_stale(spark):
    drift = [("1", 1, 0, "example", "m1", True, False), ("1", 2, 0, "example", None, False, True), ("1", 3, 0, "example", "m1", False, True)]
    assert plan(spark, drift) == [([1, 2], [0, 0]), ([3], [0])]
    stale = [("1", 1, 0, "example", "m1", True, False), ("1", 2, 0, "example", "m1", True, False), ("2", 3, 0, "example", "m1", True, True), (None, 4, 0, "example", "m1", False, True)]
    assert plan(spark, stale) == [([1], [0]), ([4], [0]), ([2], [0]), ([3], [0])]


def test_block_texts_and_ids(spark):
    df = spark.createDataFrame([(4, "4.1", 15, 3), (None, "", 15, 3), (0, "4.1", 1, 0)], "u int, l string, p int, b int")
    assert rows(df.select(blocks.block_id(*[F.col(c) for c in "ulpb"]), blocks.chunk_id(F.col("u"), F.col("l"), F.lit("example"), F.col("p"), F.col("b")))) == [("s2-u4-l4-1-p15-b3", "s2-u4-l4-1-example-p15-b3"), ("s2-uX-lX-p15-b3", "s2-uX-lX-example-p15-b3"), ("s2-u0-l4-1-p1-b0", "s2-u0-l4-1-example-p1-b0")]
    d = spark.createDataFrame([("4.1", 1, "x" * 60), (None, None, "x" * 60), (None, None, None)], "l string, u int, t string")
    got = [r[0] for r in rows(d.select(blocks.confidence(F.col("l"), F.col("u"), F.col("t"))))]
    assert got[:2] == [1.0, 0.6000000000000001] and got[2] == pytest.approx(0.2)
    c = spark.createDataFrame([("U", None, None, "H", "T", ["x"], [("d", ["a", "b"])])], "unit_title_ar string, lesson_title_ar string, lesson_title_en string, heading_ar string, main_text_ar string, math_expressions array<string>, diagrams array<struct<description: string, labels: array<string>>>")
    assert c.select(blocks.representation()).first()[0].split("\n") == ["الوحدة: U", "H", "T", "المعادلة: x", "[شكل هندسي: d. التسميات: a، b]"]


def test_boxes(spark):
    d = spark.createDataFrame([(1, [100.0, 200.0, 300.0, 400.0]), (2, [1.0, 2.0]), (3, [5.0, 5.0, 5.0, 9.0])], "i int, box_2d array<double>")
    b = blocks.pixel_boxes(blocks.boxes(d).withColumns({"width": F.lit(1000), "height": F.lit(2000)}))
    assert rows(b.select("i", "x1", "y1", "x2", "y2", "left", "top", "right", "bottom")) == [(1, 0.2, 0.1, 0.4, 0.3, 188, 188, 412, 612)]


def test_lexical_and_dense(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "")], "qa_id long, text string")
    c = spark.createDataFrame([("x", "a a c"), ("y", "z"), ("w", None), ("v", "c a a")], "chunk_id string, text string")
    assert rows(retrieval.lexical_topk(q, c), "rank") == [(1, "v", 0.632456, 1), (1, "x", 0.632456, 2)]
    ranks = retrieval.ranked(spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "q int, id string, score double"), "q", "id", 2)
    assert [r["id"] for r in ranks.orderBy("rank").collect()] == ["c", "a"]
    v = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 2.0]), ("zero", [0.0, 0.0]), ("none", None)], "chunk_id string, values array<float>")
    assert rows(retrieval.dense_topk(v.where("chunk_id = 'p'").withColumnRenamed("chunk_id", "qa_id"), v).select("chunk_id", "score"), "chunk_id") == [("p", 1.0), ("q", 0.0)]


def test_metrics_and_recall(spark):
    q = spark.createDataFrame([(1, "t"), (2, "t")], "qa_id int, question_type string")
    hits = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "qa_id int, chunk_id string, rank int")
    g = spark.createDataFrame([(1, "T1", "x"), (1, "T2", "q"), (1, "T3", None)], "qa_id int, target_id string, chunk_id string")
    assert rows(metrics.question_scores(q, hits, g).select("qa_id", "first_rank", "reciprocal_rank", "hit_at_1", "hit_at_5"), "qa_id") == [(1, 2, 0.5, False, True), (2, None, 0.0, False, False)]
    assert rows(metrics.gold_recall(q, hits, g).select("qa_id", "n_targets", "n_covered", "recall", "unresolved"), "qa_id") == [(1, 2, 1, 0.5, ["T3"]), (2, 0, 0, 0.0, [])]
    empty = metrics.summary(metrics.question_scores(q.limit(0), hits, g)).first()
    assert (empty["n_questions"], empty["mrr"]) == (0, 0.0)


@pytest.mark.parametrize(("bodies", "budget", "tokens_", "cut", "n"), [((3, 6, 4), 10, 10, True, 2), ((3, 6), 7, 5, True, 1), ((3,), 5, 5, False, 1), ((), 5, None, None, 0)])
def test_context(spark, bodies, budget, tokens_, cut, n):
    hits = spark.createDataFrame([(1, i + 1, f"c{i}", " ".join(["w"] * b)) for i, b in enumerate(bodies)], "qa_id int, rank int, chunk_id string, text string")
    out = context.assemble(hits, budget).select("token_count", "truncated", F.size("chunk_ids")).collect()
    assert [tuple(r) for r in out] == ([] if tokens_ is None else [(tokens_, cut, n)])


def test_gold_thresholds_and_fallback(spark):
    q = spark.createDataFrame([(1, "formula_retrieval", 15, ["b"]), (2, "worked_example_reasoning", 15, ["b"]), (3, "formula_retrieval", 1, ["s2-u4-l4-1-p15-b3"])], "qa_id int, question_type string, gold_page int, gold_source_block_ids array<string>")
    cb = spark.createDataFrame([(f"w{c}", "b", c) for c in (0.79, 0.80, 0.99, 1.0)] + [("null", "b", None)], "chunk_id string, block_id string, coverage double")
    cp = spark.createDataFrame([("a", 14, 15), ("c", 15, 16), ("d", 16, 17)], "chunk_id string, low int, high int")
    out = gold.by_coverage(q, cb, cp)
    assert rows(out.select("qa_id", "chunk_id", "basis"), "qa_id", "chunk_id") == [(1, "w0.8", "coverage"), (1, "w0.99", "coverage"), (1, "w1.0", "coverage"), (2, "w1.0", "coverage"), (3, "a", "page_overlap_fallback"), (3, "c", "page_overlap_fallback")]
    assert {r[0] for r in rows(gold.by_block(q.where("qa_id = 1"), cb).select("chunk_id"))} == {"w0.99", "w1.0", "null"}


def test_text(spark):
    df = spark.createDataFrame([("أحـمد  إلى",), ("ما هو X؟",), ("ما هو x",), (None,)], "t string")
    assert [r[0] for r in rows(df.select(text.normalize(F.col("t"))))][0] == "احمد الى"
    keys = [r[0] for r in rows(df.select(text.comparable(F.col("t"))))]
    assert keys[1] == keys[2] and keys[3] == ""
    w = spark.createDataFrame([("a\x1cb  c",)], "t string").select(text.ws_tokens(F.col("t"))).first()[0]
    assert w == ["a", "b", "c"]


REPLIES = [('{"score": 0.5}', "scored", 0.5), ('```json\n{"score": 0.5}\n```', "scored", 0.5), ('{"score": 1.2}', "invalid_score", None), ('{"score": "abc"}', "invalid_score", None), ('{"rationale": "x"}', "invalid_score", None), ('{"score": 0.7, "rationale": "cut', "recovered", 0.7), ("no json", "parse_error", None), ("", "parse_error", None), (None, "parse_error", None), ('{"score": 0.7,}', "parse_error", None), ('x {"a": {"b": "}"}, "score": "0.25"} y', "scored", 0.25), ('{"score": true}', "scored", 1.0)]


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, raw_response string")
    got = rows(judge.parse_replies(df).select("judge_status", "score"), "i")
    assert got == [r[1:] for r in REPLIES]
    flat = rows(judge.parse_replies(df, objects=judging.flat_object).where("i <> 10").select("judge_status", "score"), "i")
    assert flat == [r[1:] for i, r in enumerate(REPLIES) if i != 10]


def test_ledger_and_summary(spark):
    df = spark.createDataFrame([("k1", "s", "m", 1, "scored", 1.0), ("k1", "s", "m", 2, "api_error", None), ("k2", "s", "m", 3, "parse_error", None), ("k3", "s", "m", 4, "skipped_no_context", None)], "qa_id string, system string, metric string, line long, judge_status string, score double")
    assert rows(judge.ledger(df).select("qa_id", "judge_status"), "qa_id") == [("k1", "scored"), ("k3", "skipped_no_context")]
    assert rows(judge.pending(df.select("qa_id", "system", "metric").distinct(), judge.ledger(df)).select("qa_id")) == [("k2",)]
    s = spark.createDataFrame([("a", "s", "m", "scored", 1.0), ("b", "s", "m", "api_error", None), ("c", "s", "m", "scored", 0.5), ("d", "s", "m", "skipped_no_context", None)], "qa_id string, system string, metric string, judge_status string, score double")
    assert rows(judge.summary(s)) == [("m", 0.75, 2, 1, 1, 4, 4)]


def test_pairs_and_bootstrap(spark):
    s = spark.createDataFrame([("q1", "A", 1.0), ("q2", "A", 0.5), ("q3", "A", 0.2), ("q1", "B", 0.5), ("q2", "B", 0.5)], "qa_id string, system string, score double").withColumns({"metric": F.lit("m"), "judge_status": F.lit("scored")})
    d = bootstrap.paired_differences(s, "A", "B")
    assert rows(d.select("difference"), "qa_id") == [(0.5,), (0.0,)]
    r = bootstrap.bootstrap(d, 100).first()
    assert (r["n"], r["mean"]) == (2, 0.25) and 0 <= r["lower"] <= r["upper"] <= 0.5
    assert bootstrap.bounds(2000, 0.95) == (50, 1949)
    assert bootstrap.bootstrap(d, 0).first()["lower"] is None


def test_cer(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("ab", "abcdef"), (" ", "x")], "a string, b string")
    out = quality.cer_rows(df, "a", "b", ())
    assert rows(out, "edits") == [(1, 4, 0.25), (4, 2, 2.0)]
    assert rows(quality.cer_summary(out)) == [(2, 0.833333, 1.125)]


def test_selection_cap(spark):
    df = spark.createDataFrame([("a1", "a", 1), ("a2", "a", 2), ("b1", "b", 3), ("c1", "c", 4)], "id string, lesson string, o int")
    assert [r[0] for r in qa._capped(df, F.col("o"), 4, 1, "lesson", False).collect()] == ["a1", "b1", "c1", "a2"]


def test_validation_rules(spark):
    good = ("generated", "ما تعريف المثلث؟", "شكل له ثلاثة أضلاع", "definition_recall", False, False, ["other"], False)
    data = [(1, *good), (2, *good), (3, "parse_failed", *good[1:]), (4, "generated", "", *good[2:]), (5, "generated", "ما في الصفحة الأولى؟", *good[2:]), (6, *good[:3], "riddle", *good[4:]), (7, "generated", "x", *good[2:])]
    df = spark.createDataFrame(data, "candidate_id long, status string, question string, answer string, question_type string, required_formula boolean, required_diagram boolean, source_types array<string>, described boolean")
    got = dict(rows(qa.validate(df).select("candidate_id", "rejection_reason")))
    assert got == {1: None, 2: "duplicate of 1", 3: "non-generated status: parse_failed", 4: "missing question or answer", 5: "banned phrase: الصفحة", 6: "invalid question_type: riddle", 7: "question length 1 out of bounds"}


def test_settings():
    s = override(Settings(), {"retrieval": {"top_k": 3, "hit_at": [1, 5]}})
    assert s.retrieval.reported == (1, 3) and as_dict(s)["retrieval"]["hit_at"] == [1, 5]
    assert Settings("b1").recall_name == "gold_page_recall_proxy"
    with pytest.raises(ValueError, match="unknown"):
        override(Settings(), {"nothing": 1})
    with pytest.raises(ValueError, match="unknown"):
        override(Settings(), {"system": "b1"})


def test_replies_become_candidates(spark):
    data = [
        ("t1", '```json\n{"question_ar": "q", "answer_reference_ar": "a", "required_diagram": "yes", "required_formula": []}\n```', None), ("t2", "[]", None), ("t3", "", None), ("t4", None, None),
        ("t5", '{"question_ar": null, "difficulty": null}', None), ("t6", '{"question_ar": "q"}', "timeout"), ("t7", '{"question_ar": "q"', None),
    ]
    tasks = spark.createDataFrame(data, "task_id string, raw_response string, error string").withColumns({"question_type": F.lit("theorem_statement"), "pages": F.array(F.lit(3))})
    got = {r["task_id"]: r for r in generation.candidates(tasks, keep=("pages",)).collect()}
    assert [got[f"t{i}"]["status"] for i in range(1, 8)] == ["generated", "parse_failed", "parse_failed", "parse_failed", "generated", "generation_failed", "parse_failed"]
    one = got["t1"]
    assert (one["question"], one["answer"], one["difficulty"], one["answer_mode"], one["required_diagram"], one["required_formula"], one["pages"]) == ("q", "a", "easy", "extractive", True, False, [3])
    assert got["t5"]["question"] is None and got["t6"]["parse_error"] == "timeout" and got["t2"]["parse_error"] == "response was not a JSON object" and got["t6"]["difficulty"] is None
    done = generation.candidates(tasks.where("task_id < 't4'"))
    assert rows(generation.unanswered(tasks, done).select("task_id"), "task_id") == [("t4",), ("t5",), ("t6",), ("t7",)]
    assert generation.unanswered(tasks, done, force=True).count() == 7 and generation.unanswered(tasks, None).count() == 7
    final = generation.final_records(generation.candidates(tasks).where("task_id = 't5'").withColumns({"qa_id": F.lit("qa-0001"), "gold_page_numbers": F.lit(None).cast("array<int>")})).first()
    assert (final["question"], final["gold_page_numbers"], final["status"], final["difficulty"]) == ("", [], "validated", "easy")


def test_prompts_number_their_sources(spark):
    chunk = spark.createDataFrame([("c", "1.1", "T", "theorem", None, " text ", None)], "chunk_id string, lesson_number string, lesson_title_ar string, content_type string, heading_ar string, main_text_ar string, math_expressions array<string>")
    chunk = chunk.withColumn("diagrams", F.array(F.struct(F.lit(" d ").alias("description"), F.array(F.lit("A")).alias("labels")), F.struct(F.lit("").alias("description"), F.array().cast("array<string>").alias("labels"))))
    p = generation.snapshot(chunk)
    one, two = chunk.select(generation.prompt(F.lit("Do."), F.array(p), "Form."), generation.prompt(F.lit("Do."), F.array(p, p), "Form.")).first()
    body = 'Lesson: 1.1 T\nContent type: theorem\nText:\ntext\nDiagram(s): [{"description":"d","labels":["A"]}]'
    assert one == f"Do.\n\n--- Source ---\n{body}\n\nForm." and two.count("--- Source 1 ---") == two.count("--- Source 2 ---") == 1


def test_inputs_of_reports(spark):
    records = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "2", "y")], "system string, qa_id string, question_type string")
    summaries = spark.createDataFrame([("a", 2, 5), ("b", 2, 5)], "system string, n long, top_k int")
    integrity.required(integrity.retrieval_inputs(records, summaries, ("a", "b")))
    bad = {r["check"]: r["n_failures"] for r in integrity.retrieval_inputs(records.where("not (system = 'b' and qa_id = '2')"), summaries.withColumn("top_k", F.when(F.col("system") == "a", 5).otherwise(0)), ("a", "b")).collect()}
    assert {k for k, v in bad.items() if v} == {"counts_agree", "ids_are_the_same", "one_top_k"}
    with pytest.raises(ValueError, match="every_system"):
        integrity.required(integrity.judge_inputs(spark.createDataFrame([("a", "m", 256)], "system string, metric string, context_budget int"), ("a", "b")))
    ends = spark.createDataFrame([([3, 5], 9), ([3], 9), (None, 9), (None, None), ([None, 4], 2)], "p array<int>, n int").select(*integrity.page_range(F.col("p"), F.col("n")))
    assert rows(ends) == [(3, 5), (9, 9), (9, 9), (-1, -1), (2, 2)]


def test_unions_and_full_summary(spark):
    cover = spark.createDataFrame([("s", 0, "b1"), ("s", 0, "b2"), ("s", 1, "b3"), ("s", 2, "none")], "stream_id string, window long, block_id string")
    blocks_ = spark.createDataFrame([("b1", 2, ["u2", "u1"], None, True, False), ("b2", 1, ["u1"], ["s"], False, False), ("b3", 3, [], [], None, True)], "block_id string, position long, diagram_image_urls array<string>, standards array<string>, has_diagram boolean, has_math boolean")
    assert rows(windows.block_unions(cover, blocks_).drop("stream_id"), "window") == [(0, ["u1", "u2"], ["s"], True, False), (1, [], [], False, True), (2, [], [], False, False)]
    scores = spark.createDataFrame([("b", 1.0, 1.0, True, True, 1, 10), ("odd", 0.0, 0.0, False, False, 0, None), ("a", 0.5, 1.0, False, True, 2, 5)], "question_type string, reciprocal_rank double, recall double, hit_at_1 boolean, hit_at_5 boolean, n_targets int, token_count int")
    got = rows(metrics.full_summary(scores, ("a", "b")).select("position", "question_type", "n_questions", "mrr", "context_tokens", "with_gold", "without_gold"), "position")
    assert got == [(0, "overall", 3, 0.5, 15, 2, 1), (1, "a", 1, 0.5, 5, 1, 0), (2, "b", 1, 1.0, 10, 1, 0), (3, "odd", 1, 0.0, 0, 0, 1)]
    assert rows(metrics.unexpected(scores, ("a", "b"))) == [("odd", 1)]
    empty = rows(metrics.full_summary(scores.limit(0), ("a", "b")).select("n_questions", "mrr", "context_tokens"))
    assert empty in ([], [(0, 0.0, 0)])


def test_chunks_are_numbered_in_closing_order(spark):
    """Offsets of strips give the same numbers as one window over the book."""
    data = [(f"b{i % 2}", i % 5 == 0, (i * 7919 % 50) << 22, i % 2, i % 3, i) for i in range(200)]
    df = spark.createDataFrame([(b, int(left), seq, sub, p, n) for b, left, seq, sub, p, n in data], "book string, leftover int, seq long, sub int, page_number int, block_index int")
    got = {(r["book"], r["block_index"]): r["ordinal"] for r in merge.in_order(df).collect()}
    for book in ("b0", "b1"):
        order = sorted((int(left), seq, sub, p, n) for b, left, seq, sub, p, n in data if b == book)
        assert [got[book, x[-1]] for x in order] == list(range(len(order)))
    assert merge.in_order(df.limit(0)).count() == 0
