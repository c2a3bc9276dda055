"""Sources, sinks, streams, and the registered queries against their SQL."""

import glob
import hashlib
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpuslab.operators import bootstrap, retrieval
from corpuslab.plans import catalogue
from corpuslab.plans.catalogue import QUERIES
from corpuslab.plans.oracles import ORACLES
from corpuslab.sources import readers, writers
from corpuslab.streaming import ledger

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert table([tuple(r) for r in got.collect()], got.columns) == table(want.fetchall(), names)


def test_merged_blocks_hold_every_block_once(spark):
    rows = QUERIES["merge_blocks_full"](spark, SF)
    ids = rows.select(F.explode(F.split("blocks", r"\|")).alias("b"))
    assert ids.count() == ids.distinct().count() == QUERIES["block_ids"](spark, SF).count()


def test_block_table_is_whole(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = {(r["page_number"], r["block_index"]) for r in QUERIES["block_table"](spark, sf).collect()}
    assert max(got)[0] > 500 and min(got)[0] < 10
    pages = spark.createDataFrame([("9",), ("10",), ("500",), ("501",), ("x",), (None,)], "p string")
    inside = lambda *r: [x["p"] for x in pages.where(readers.in_range(F.col("p"), *r)).collect()]
    assert inside(10, 500) == ["10", "500"] and inside(0, None) == ["9", "10", "500", "501"]


def test_bootstrap_of_all_pairs_equals_brute_force(spark):
    d = [r["difference"] for r in bootstrap.paired_differences(catalogue._mock_pairs(spark, SF), "proposed", "b2").orderBy("qa_id").collect()]
    n = len(d)
    draw = lambda b, i: int(hashlib.sha256(f"7-{b}-{i}".encode()).hexdigest()[:8], 16) % n
    means = sorted(sum(d[draw(b, i)] for i in range(n)) / n for b in range(2000))
    got = QUERIES["paired_bootstrap"](spark, SF).first()
    assert got["n"] == n and tuple(got)[2:] == pytest.approx((sum(d) / n, means[50], means[1949]), abs=2e-6)
    assert QUERIES["paired_bootstrap"](spark, "/root/testdata/sf0.01").first()["n"] > 100


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    texts = ["the ñandú eats thé cake", "كتاب the جديد", "مثلث", "один the two", "", None, "😀 other"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {i: (edits(t, t.replace("e", "\0").replace("o", "").replace("\0", "o").replace("th", "t")), len(t)) for i, t in enumerate(texts) if t}
    got = {r["conv_id"]: (r["edits"], r["length"]) for r in QUERIES["cer_blocks"](spark, str(tmp_path)).collect()}
    assert got == want
    one = QUERIES["cer_summary"](spark, str(tmp_path)).first()
    assert one["n"] == 5 and one["micro_cer"] == pytest.approx(sum(e for e, _ in want.values()) / sum(n for _, n in want.values()), abs=1e-6)


def test_lexical_paths_agree(spark):
    """Terms sent to the tasks, in small blocks too, or joined by shuffle: the same hits."""
    q, d = catalogue.A.questions(spark, SF).select("qa_id", "text"), catalogue.A.corpus(spark, SF).select("chunk_id", "text")
    d = d.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "the")], "chunk_id long, text string"))
    hits = lambda: sorted(map(tuple, retrieval.lexical_topk(q, d).collect()))
    want = hits()
    assert len(want) > 100 and sorted(map(tuple, retrieval._by_shuffle(q, d.where("chunk_id is not null"), 5, "qa_id", "chunk_id").collect())) == want
    rng = np.random.default_rng(1)
    tokens, sizes = rng.integers(0, 30, 400), np.full(40, 10)
    terms = retrieval._Terms(list(range(7)), [rng.integers(0, 40, 6) for _ in range(7)])
    whole = [np.stack(x).T.tolist() for x in terms.best(tokens, sizes, 40)]
    try:
        retrieval.SCORES = 30
        parts = [np.stack(x).T.tolist() for x in terms.best(tokens, sizes, 40)]
    finally:
        retrieval.SCORES = 1 << 22
    assert len(parts) > 5 and sorted(sum(parts, [])) == sorted(sum(whole, []))
    assert retrieval.lexical_topk(q.limit(0), d).count() == 0 and retrieval.lexical_topk(q, d.limit(0)).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_kernels_stay_in_the_jvm(spark):
    for name in ("fixed_windows", "dense_topk", "gold_coverage_match", "qa_validation", "judge_parse", "paired_bootstrap"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_readers_and_writers(spark, tmp_path):
    for i, page in enumerate([{"page_number": 3, "content_blocks": [{"block_index": 0, "text_ar": "x"}]}, {"page_number": 9}]):
        (tmp_path / f"page_{i}.json").write_text(json.dumps(page))
    (tmp_path / "page_7.json").write_text("{broken")
    pages = readers.pages(spark, str(tmp_path / "page_*.json"), 1, 5)
    assert [r["page_number"] for r in pages.collect()] == [3] and readers.blocks(pages).count() == 1
    assert readers.jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "list.json"), "a int").count() == 2
    (tmp_path / "dict.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no JSON list"):
        readers.json_array(spark, str(tmp_path / "dict.json"), "a int").collect()
    df = spark.createDataFrame([("k", [1.0]), ("m", [])], "id string, values array<double>")
    writers.jsonl(df, str(tmp_path / "out"))
    assert readers.jsonl(spark, str(tmp_path / "out"), "id string, values array<double>").count() == 2
    writers.csv(df, str(tmp_path / "csv"), ["id", "values", "extra"])
    parts = [p.read_text() for p in (tmp_path / "csv").glob("part-*")]
    assert all(p.startswith("﻿id,values,extra") for p in parts if p) and any("[1.0]" in p for p in parts)
    new = spark.createDataFrame([("k", [2.0])], "id string, values array<double>")
    assert [tuple(r) for r in writers.upserted(df, new, "id").collect()] == [("k", [2.0])]


def test_stream_merges_into_the_ledger(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rec = lambda q, line, status, score: json.dumps({"qa_id": q, "system": "s", "metric": "m", "judge_status": status, "score": score, "line": line})
    for n, lines in enumerate([[rec("a", 1, "scored", 0.1), rec("b", 2, "api_error", None)], [rec("a", 3, "scored", 0.9), rec("b", 4, "scored", 0.5)]]):
        (src / f"{n}.json").write_text("\n".join(lines))
        ledger.run_ledger(ledger.judge_records(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "t" / "v1"))
    assert {(r["qa_id"], r["score"]) for r in out.collect()} == {("a", 0.9), ("b", 0.5)}
