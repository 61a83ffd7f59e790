"""Small sources of the driver: commits, schedules, evaluations, prompts."""

from __future__ import annotations

import glob
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_COMMITS = 200


def _lines(command: list[str], seconds: int) -> list[str]:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=seconds, check=True).stdout.splitlines()
    except (OSError, subprocess.SubprocessError):
        return []


def commits(spark: SparkSession, root: str) -> DataFrame:
    """line_no, line of the commit graph, the newest 200; empty without a repository."""
    found = _lines(["git", "-C", root, "log", "--all", "--graph", "--oneline", "--decorate", "-n", str(MOST_COMMITS)], 10)
    return spark.createDataFrame(list(enumerate(found, 1)), "line_no int, line string")


def schedules(spark: SparkSession, names: list[str]) -> DataFrame:
    """line of the crontab that name one of the commands."""
    rows = spark.createDataFrame([(x,) for x in _lines(["crontab", "-l"], 5)], "line string")
    return rows.where(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(F.col("line"), n)))


def newest_file(pattern: str) -> str | None:
    """The file that was changed last."""
    return max(glob.glob(pattern), key=os.path.getmtime, default=None)


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """eval_id, prompt, n_expectations of a file of cases."""
    schema = "evals array<struct<id: string, prompt: string, expectations: array<string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("evals").alias("e"))
    return rows.select(F.col("e.id").alias("eval_id"), F.substring("e.prompt", 1, 140).alias("prompt"), F.greatest(F.size("e.expectations"), F.lit(0)).alias("n_expectations"))


def evaluation_runs(spark: SparkSession, path: str) -> DataFrame:
    """eval_id, configuration, pass_rate of a benchmark file."""
    schema = "runs array<struct<eval_id: string, configuration: string, result: struct<pass_rate: double>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("runs").alias("r"))
    return rows.select("r.eval_id", "r.configuration", F.col("r.result.pass_rate").alias("pass_rate"))


def prompt(folder: str, name: str, fallback: str) -> str:
    """Text of a prompt file, or the built-in one."""
    try:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            return f.read().strip() or fallback
    except OSError:
        return fallback
