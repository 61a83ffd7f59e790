"""python -m docloom ingest [--force] ROOT | dream [--force] ROOT... | dashboard ROOT [FILE] | validate ROOT | query NAME DIR

ROOT is a tree of documents on a disk that all workers share; DIR holds tables (validate takes one, too). Exit 0 if
all is well, 1 for a bad call or flagged aggregates of validate, 2 if ingest skipped or flagged
something (E1-E4, A10, A13, A14).
"""

from __future__ import annotations

import datetime
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docloom.functions.render import dashboard_lines
from docloom.operators import validation
from docloom.plans import config, core_queries, dream, ingest
from docloom.session import cut
from docloom.sources import extras
from docloom.sources.okf import read_transcripts, read_tree


def ingest_tree(spark: SparkSession, root: str, force: bool) -> int:
    done, counts = ingest.run(spark, root, config.load(root), force)
    print(f"{done.n_derived} derived, {done.n_summaries} folders summarised, {done.n_flagged} flagged; " + ", ".join(f"{n} {what}" for what, n in counts.items()))
    for row in done.skipped.orderBy("rel_path").toLocalIterator():
        print(f"skipped {row['rel_path']}: {row['reason']}")
    return 2 if done.n_flagged or not done.skipped.isEmpty() else 0


def dream_tree(spark: SparkSession, root: str, force: bool) -> int:
    done, counts = dream.run(spark, root, config.load(root), force, now=datetime.date.today().isoformat())
    print(f"{root}: " + ("unchanged" if done.synthesis is None else ", ".join(f"{n} {what}" for what, n in counts.items())))
    return 0


def dashboard_page(spark: SparkSession, root: str, target: str) -> int:
    commits = [r['line'] for r in extras.commits(spark, root).orderBy('line_no').collect()]  # at most 200
    schedules = [r['line'] for r in extras.schedules(spark, ["docloom"]).collect()]
    newest = extras.newest_file(os.path.join(root, "evals", "benchmark*.json"))
    runs = [(f"{r['eval_id']} {r['configuration']}", r["pass_rate"]) for r in extras.evaluation_runs(spark, newest).collect()] if newest else []
    with open(f"{target}.part", "w", encoding="utf-8") as f:
        f.writelines(dashboard_lines(os.path.basename(os.path.abspath(root)), config.load(root).summary(), read_tree(spark, root), commits=commits, schedules=schedules, runs=runs))
    os.replace(f"{target}.part", target)
    print(target)
    return 0


def validate_tree(spark: SparkSession, root: str) -> int:
    """Every aggregate and matter of a tree, against the transcripts of its sources where there are any."""
    concepts = read_tree(spark, root).withColumn("concept_id", F.col("path"))
    report = cut(validation.report(validation.findings(concepts, read_transcripts(spark, root))))
    for row in report.where("not passed").orderBy("concept_id").toLocalIterator():
        print(f"{row['concept_id']}\n  " + row["banner"].replace("\n\n", "\n  "))
    total, flagged = report.count(), report.where("not passed").count()
    print(f"{total} aggregates, {flagged} flagged")
    return 1 if flagged else 0


def main(args: list[str]) -> int:
    force, args = "--force" in args, [a for a in args if a != "--force"]
    folders = {"ingest": args[1:2], "dream": args[1:], "dashboard": args[1:2], "validate": args[1:2], "query": args[2:3]}.get(args[0] if args else "", [])
    if not folders or not all(map(os.path.isdir, folders)):
        print(__doc__)
        return 1
    spark = SparkSession.builder.appName("docloom").getOrCreate()
    if args[0] == "ingest":
        return ingest_tree(spark, args[1], force)
    if args[0] == "dream":
        return dream.exit_code([dream_tree(spark, root, force) for root in folders])
    if args[0] == "dashboard":
        return dashboard_page(spark, args[1], args[2] if len(args) > 2 else os.path.join(args[1], "dashboard.html"))
    if args[0] == "validate" and not os.path.exists(os.path.join(args[1], "concepts.parquet")):
        return validate_tree(spark, args[1])
    if args[0] == "validate":
        row = core_queries.QUERIES["validate_summary"](spark, args[1]).first()
        print(f"{row['n_aggregates']} aggregates, {row['n_flagged']} flagged")
        return row["exit_code"]
    core_queries.QUERIES[args[1]](spark, args[2]).select(F.col("*")).show(50, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
