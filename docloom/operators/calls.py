"""Summaries of the model call log and of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_calls(calls: DataFrame) -> DataFrame:
    """One row a call_id: exact repeats are dropped, of differing ones the last logged is kept."""
    columns = [c for c in calls.columns if c != "call_id"]
    return calls.groupBy("call_id").agg(F.max_by(F.struct(*columns), F.struct("logged_at", "duration_ms")).alias("x")).select("call_id", "x.*")


def call_summary(calls: DataFrame) -> DataFrame:
    """model, n_calls, n_failed, retries, mean_ms, most_ms, chars."""
    return distinct_calls(calls).groupBy("model").agg(
        F.count("*").alias("n_calls"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("n_failed"),
        F.sum(F.coalesce("attempts", F.lit(1)) - 1).cast("long").alias("retries"),
        F.round(F.avg("duration_ms"), 6).alias("mean_ms"),
        F.max("duration_ms").alias("most_ms"),
        F.sum("prompt_chars").cast("long").alias("chars"),
    )


def mean_by_configuration(runs: DataFrame, key: str, configuration: str, rate: str, names: list[str]) -> DataFrame:
    """key, mean of each configuration, and delta of the first two."""
    means = [F.avg(F.when(F.col(configuration) == n, F.col(rate))).alias(n) for n in names]
    return runs.where(F.col(configuration).isin(*names)).groupBy(key).agg(*means).withColumn("delta", F.col(names[0]) - F.col(names[1]))
