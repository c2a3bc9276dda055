"""The pipeline's stages, each against what the stage promises."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = docs.limit(1).select(F.lit(10_000).cast("long").alias("doc_id"), F.lit("12345 67890").alias("text"), "lang", "source", "n_chars")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leak = docs.limit(1).select(F.lit(10_001).cast("long").alias("doc_id"), F.lit("Words before it. " + item + " And after it.").alias("text"), "lang", "source", "n_chars")
    copy = docs.where("doc_id = 5").withColumn("doc_id", F.lit(10_002).cast("long"))
    now = docs.unionByName(planted).unionByName(leak).unionByName(copy)
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert set(out.columns) == set(docs.columns), name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r[0] for r in now.select("doc_id").collect()})
    before = {r[0] for r in docs.select("doc_id").collect()}
    assert 10_000 not in seen[0] and seen[0] >= before
    assert 10_002 not in seen[1] and 5 in seen[1]
    assert seen[2] == seen[1] and 10_001 in seen[2] and 10_001 not in seen[3]
    assert len(seen[3]) >= 0.9 * len(seen[2]) and seen[4] == seen[3]


def test_near_duplicates_shuffle_texts_once(spark, shuffled, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(200)]
    texts += [t + f" {i} end" for i, t in enumerate(texts[:4])]
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    moved = shuffled(lambda: corpus_pipeline.drop_near_duplicates(spark, docs, SF).write.parquet(str(tmp_path / "out")))
    left = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, left.collect())) == rows[:200]
    assert moved < 1.3 * sum(map(len, texts))


def test_queries_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
