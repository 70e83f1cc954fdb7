"""``python -m gristmill``: ingest, ask, eval, selfcheck, doctor and verify from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.evaluate import deterministic_view, report
from .plans.engine import Engine
from .sources.corpus import read_cases


#: What ``verify`` asks of an evaluation at least.
FLOORS = {"route_accuracy": 1.0, "doc_hit_rate": 0.95, "doc_mrr": 0.85, "recall": 0.80, "mrr": 0.85, "ndcg": 0.75, "grounding_rate": 0.95}


def doctor(spark: SparkSession) -> dict:
    """What the engine needs, and whether it is there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = {
        "spark": spark.version,
        "cores": spark.sparkContext.defaultParallelism,
        "arrow": spark.range(1).mapInArrow(lambda rows: rows, "id long").count() == 1,
        "checkpoint_dir": folder or "",
        "checkpoint_dir_set": bool(folder) or spark.sparkContext.master.startswith("local["),
        "adaptive": spark.conf.get("spark.sql.adaptive.enabled") == "true",
    }
    return found | {"passed": found["arrow"] and found["checkpoint_dir_set"]}


def verify(engine: Engine, cases: str, floors: dict[str, float]) -> dict:
    """Self-check, evaluation above its floors, and the same figures when run again."""
    rows = read_cases(engine.spark, cases)
    one, two = (deterministic_view(report(engine.evaluate_cases(rows))).first().asDict() for _ in range(2))
    stages = {"selfcheck": engine.selfcheck()["passed"], "floors": all(one[k] >= v for k, v in floors.items()), "determinism": one == two}
    return stages | {"evaluation": one, "passed": all(stages.values())}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gristmill")
    parser.add_argument("--corpus", action="append", default=[], help="file or folder of texts; may come again")
    sub = parser.add_subparsers(dest="verb", required=True)
    sub.add_parser("ingest")
    sub.add_parser("selfcheck")
    ask = sub.add_parser("ask")
    ask.add_argument("question", nargs="+")
    ask.add_argument("-k", type=int)
    sub.add_parser("doctor")
    for name in ("eval", "verify"):
        score = sub.add_parser(name)
        score.add_argument("cases")
        score.add_argument("--min-recall", type=float, default=0.0 if name == "eval" else FLOORS["recall"])
    args = parser.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("gristmill").getOrCreate())
    if args.verb == "doctor":
        shown = doctor(engine.spark)
        print(json.dumps(shown, ensure_ascii=False))
        return int(not shown["passed"])
    shown = engine.ingest_paths(*args.corpus) if args.corpus else engine.stats()
    if args.verb == "ask":
        rows = engine.spark.createDataFrame([(str(i), q) for i, q in enumerate(args.question)], "query_id string, text string")
        for row in engine.ask(rows, args.k).orderBy("query_id").toLocalIterator():
            print(json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        return 0
    failed = False
    if args.verb == "eval":
        shown = engine.evaluate(read_cases(engine.spark, args.cases))
        failed = shown["recall"] < args.min_recall
    elif args.verb == "verify":
        shown = verify(engine, args.cases, FLOORS | {"recall": args.min_recall})
        failed = not shown["passed"]
    elif args.verb == "selfcheck":
        shown = engine.selfcheck()
        failed = not shown["passed"]
    print(json.dumps(shown, ensure_ascii=False))
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
