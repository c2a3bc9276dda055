"""The runs end to end on a small book, and providers."""

from pyspark.sql import functions as F

from corpuslab.operators import providers, reports
from corpuslab.plans import runs
from corpuslab.plans.config import Selection, Settings, override

BLOCKS = "array<struct<block_index: int, content_type: string, heading_ar: string, problem_numbers: array<int>, text_ar: string, math_expressions: array<string>, diagrams: array<struct<diagram_index: int, box_2d: array<double>, description: string, labels: array<string>>>, named_elements: struct<theorems: array<string>, definitions: array<string>, vocabulary: array<struct<term_ar: string, term_en: string>>, standards: array<string>>, continues_to_next_page: boolean, continued_from_prev_page: boolean>>"


def book(spark):
    kinds = ("definition", "theorem", "example", "exercise", "other")
    rows = []
    for p in range(1, 25):
        content = [(i, kinds[(p + i) % 5], f"h{p}", [p], f"block {p} {i} of lesson {p // 5} " + "step الحل word " * 25, [f"x={p}"] if i == 1 else [], [(0, None, f"figure {p}", ["A", "B"])] if i == 2 else [], ([], [f"term{p}"] if i == 0 else [], [], []), i == 2 and p % 2 == 1, i == 0 and p % 2 == 0) for i in range(3)]
        rows.append(("b", p, p // 8 or None, f"unit {p // 8}", f"{p // 5}.1", f"lesson {p // 5}", None, None, content))
    return spark.createDataFrame(rows, f"book string, page_number int, unit_number int, unit_title_ar string, lesson_number string, lesson_title_ar string, lesson_title_en string, standard string, content_blocks {BLOCKS}")


def test_all_systems(spark, tmp_path):
    pages = book(spark)
    base = override(Settings(), {"selection": {"quota": 4}, "windows": {"size": 120, "overlap": 20}, "judge": {"resamples": 50}})
    assert base.selection == Selection(quota=4)
    store = runs.Store(spark, str(tmp_path / "proposed"))
    made = runs.ingest(base, pages, store)
    assert made["chunks"].count() > 40
    questions = runs.question_set(base, made["chunks"], store)["dataset"]
    assert questions.count() == 20 and questions.select("qa_id").distinct().count() == 20
    ledgers = []
    for system in ("proposed", "b2", "b1"):
        s = Settings(system, windows=base.windows, selection=base.selection, judge=base.judge)
        own = runs.Store(spark, str(tmp_path / f"run-{system}"))
        source = pages.select("book", "page_number", F.array_join(F.transform("content_blocks", lambda b: b["text_ar"]), "\n").alias("text")) if system == "b1" else pages
        m = runs.ingest(s, source, own)
        targets = runs.map_gold(s, questions, m)
        out = runs.evaluate(s, questions, m, targets, own)
        assert out["records"].count() == 20 and out["summary"].where("question_type = 'overall'").first()["n_questions"] == 20
        assert {r[0] for r in out["records"].select("recall_name").distinct().collect()} == {s.recall_name}
        judged = runs.judge_run(s, questions, out["records"], own)
        assert judged["ledger"].count() == 80 and judged["calls"].count() == 80
        assert runs.judge_run(s, questions, out["records"], own)["calls"].count() == 0  # nothing is asked twice
        ledgers.append(judged["ledger"])
        assert runs.index(m["texts"], providers.hashing_embedder(16), own).count() == runs.index(m["texts"], providers.hashing_embedder(16), own).count()
    both = ledgers[0].unionByName(ledgers[1])
    table = runs.compare(base, both)
    assert table.count() == 4 and "| metric |" in reports.markdown(table, "Comparison")


def test_retries_and_errors(spark):
    def flaky(prompts):
        if "bad" in prompts[0]:
            raise RuntimeError("down")
        return ["no json" if "odd" in p else '{"score": 0.5}' for p in prompts]

    df = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", "odd")], "k string, prompt string")
    got = {r["k"]: (r["judge_status"], r["score"], r["retries_used"]) for r in providers.outcomes(providers.ask(df, "prompt", flaky)).collect()}
    assert got == {"a": ("scored", 0.5, 0), "b": ("api_error", None, 2), "c": ("parse_error", None, 2)}


def test_only_scores_end_the_attempts(spark):
    """A recovered or invalid score is asked again; each attempt is logged with its time and status."""
    df = spark.createDataFrame([("a", '{"score": 0.5}'), ("b", '"score": 0.5, cut'), ("c", '{"score": 7}'), ("d", '{"score": "0.25"}')], "k string, prompt string")
    asked = providers.ask(df, "prompt", lambda prompts: prompts, batch=3)
    got = {r["k"]: (r["judge_status"], r["score"], r["retries_used"]) for r in providers.outcomes(asked).collect()}
    assert got == {"a": ("scored", 0.5, 0), "b": ("recovered", 0.5, 2), "c": ("invalid_score", None, 2), "d": ("scored", 0.25, 0)}
    log = providers.call_log(asked, "k")
    assert log.count() == 8 and {r["parse_status"] for r in log.where("k = 'b'").collect()} == {"recovered"} and log.where("latency_ms < 0 or at is null").count() == 0


def test_generation_goes_on_where_it_stopped(spark, tmp_path):
    """Answered and failed tasks are asked once; ``force`` asks the tasks given again and leaves the other records."""
    store = runs.Store(spark, str(tmp_path))
    tasks = spark.createDataFrame([(f"t{i}", "definition", "down" if i == 1 else f"p{i}") for i in range(4)], "task_id string, question_type string, prompt string")

    def model(word):
        def reply(prompts):
            if "down" in prompts:
                raise RuntimeError("down")
            return [f'{{"question_ar": "{word} {p}"}}' for p in prompts]

        return reply

    state = lambda df: {r["task_id"]: (r["status"], r["question"]) for r in df.collect()}
    assert state(runs.generate(tasks.where("task_id < 't2'"), store, model("one"))) == {"t0": ("generated", "one p0"), "t1": ("generation_failed", None)}
    assert state(runs.generate(tasks, store, model("two"))) == {"t0": ("generated", "one p0"), "t1": ("generation_failed", None), "t2": ("generated", "two p2"), "t3": ("generated", "two p3")}
    again = runs.generate(tasks.where("task_id = 't2'"), store, model("three"), force=True)
    assert again.count() == 4 and state(again)["t2"] == ("generated", "three p2") and state(again)["t3"] == ("generated", "two p3")


def test_cells():
    assert [reports.show(v, k) for v, k in ((None, ""), (True, ""), (0.5, ""), (0.123, "%"), (0.012, "+%"), (1234, "n"))] == ["—", "yes", "0.5000", "12.3%", "+1.2%", "1,234"]


def test_page_replies(spark):
    from corpuslab.operators import extraction

    data = [(1, '```json\n{"page_number": 9, "lesson_number": "1.1", "content_blocks": [{"block_index": 0, "text_ar": "x"}]}\n```'), (2, "nothing"), (3, "[1]"), (4, '{"error": "blank"}'), (5, '{"content_blocks": "text"}'), (6, None)]
    parsed = extraction.parse_pages(spark.createDataFrame([("b", *d) for d in data], "book string, page_number int, raw_response string"))
    assert [(r["page_number"], r["content_blocks"][0]["text_ar"]) for r in extraction.pages(parsed).collect()] == [(1, "x")]
    assert {r["page_number"]: r["reason"] for r in extraction.failures(parsed).collect()} == {2: "no JSON", 3: "no object", 4: "error: blank", 5: "schema violation", 6: "no JSON"}
    assert extraction.pending(parsed, extraction.pages(parsed), "book", "page_number").count() == 5


def test_command_line(spark, tmp_path, capsys):
    from corpuslab.__main__ import main

    book(spark).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "config.json").write_text('{"selection": {"quota": 2}}')
    common = ["--store", str(tmp_path / "store"), "--config", str(tmp_path / "config.json")]
    assert main(["evaluate", *common]) == 2
    assert main(["ingest", "--pages", str(tmp_path / "pages"), *common]) == 0
    assert main(["questions", *common]) == 0
    assert main(["evaluate", "--top-k", "3", *common]) == 0 and "| overall |" in capsys.readouterr().out
    assert main(["judge", "--recover", *common]) == 2
    assert main(["judge", "--limit", "2", *common]) == 0
    store = runs.Store(spark, str(tmp_path / "store"))
    assert store.get("ledger").select("qa_id").distinct().count() == 2
    assert main(["judge", "--force", *common]) == 0
    assert store.get("ledger").select("qa_id").distinct().count() == 10 and store.get("calls").count() == 40
    assert main(["judge", "--recover", *common]) == 0 and store.get("ledger").count() == 40
    assert main(["evaluate", "--retriever", "dense", "--top-k", "3", *common]) == 0
    assert store.get("hits").groupBy("qa_id").count().where("count > 3").count() == 0 and store.get("vectors").count() > 0
    assert main(["ingest", "--dry-run", *common]) == 0 and '"quota": 2' in capsys.readouterr().out
    (tmp_path / "config.json").write_text('{"nothing": 1}')
    assert main(["judge", *common]) == 2
