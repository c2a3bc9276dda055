"""``python -m corpuslab ingest|questions|evaluate|judge``: the runs over Parquet tables.

Exit codes: 1 for unmet quotas, 2 for bad arguments or missing tables.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from corpuslab.operators import judge, providers, reports, retrieval
from corpuslab.plans import runs
from corpuslab.plans.config import SYSTEMS, Settings, as_dict, override


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpuslab", description=__doc__)
    p.add_argument("run", choices=("ingest", "questions", "evaluate", "judge"))
    p.add_argument("--system", choices=sorted(SYSTEMS), default="proposed")
    p.add_argument("--pages", help="Parquet of pages (book, page_number, content_blocks or text)")
    p.add_argument("--store", required=True, help="folder of the system's tables")
    p.add_argument("--questions", help="folder of the question run; default: --store")
    p.add_argument("--config", help="JSON file of settings to replace")
    p.add_argument("--top-k", type=int)
    p.add_argument("--retriever", choices=("lexical", "dense"), default="lexical", help="dense: by the stand-in embedder's vectors")
    p.add_argument("--limit", type=int, help="judge the first questions by id only")
    p.add_argument("--force", action="store_true", help="judge again what is in the ledger")
    p.add_argument("--recover", action="store_true", help="read stored replies of parse errors again and ask nothing")
    p.add_argument("--dry-run", action="store_true", help="print the settings and stop")
    a = p.parse_args(argv)
    try:
        values = json.load(open(a.config)) if a.config else {}
        if a.top_k:
            values.setdefault("retrieval", {})["top_k"] = a.top_k
        settings = override(Settings(a.system), values)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.dry_run:
        print(json.dumps(as_dict(settings), ensure_ascii=False, indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    store = runs.Store(spark, a.store)
    dataset = runs.Store(spark, a.questions or a.store).get("dataset")
    made = {n: store.get(n) for n in ("chunks", "coverage", "page_ranges", "texts")}
    needs = {"ingest": a.pages, "questions": made["chunks"], "evaluate": made["texts"] if dataset is not None else None, "judge": store.get("records") if dataset is not None else None}[a.run]
    if needs is None:
        print(f"{a.run}: an input table is missing", file=sys.stderr)
        return 2
    if a.run == "ingest":
        runs.ingest(settings, spark.read.parquet(a.pages), store)
    elif a.run == "questions":
        try:
            runs.question_set(settings, made["chunks"], store)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.run == "evaluate":
        find = runs.dense(providers.hashing_embedder(), store) if a.retriever == "dense" else retrieval.lexical_topk
        out = runs.evaluate(settings, dataset, made, runs.map_gold(settings, dataset, made), store, find)
        print(reports.markdown(out["summary"], f"Retrieval, {settings.system}"))
    elif a.recover:
        ledger = runs.recover_run(store)
        if ledger is None:
            print("judge: there is no ledger", file=sys.stderr)
            return 2
        print(reports.markdown(judge.summary(ledger, ("system", "metric")), f"Judge, {settings.system}"))
    else:
        out = runs.judge_run(settings, dataset, store.get("records"), store, limit=a.limit, force=a.force)
        print(reports.markdown(out["summary"], f"Judge, {settings.system}"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
