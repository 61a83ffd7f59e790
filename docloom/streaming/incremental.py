"""Incremental ingest and event windows as Structured Streaming (I1, extensions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.incremental import clean_hash, clean_path


def stream_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def new_versions(scans: DataFrame) -> DataFrame:
    """Scans with a hash, with clean rel_path and version. No watermark: however late a scan is, it comes through; process_new drops what is delivered again."""
    return scans.where("rel_path is not null and sha256 is not null").withColumn("rel_path", clean_path(F.col("rel_path"))).withColumn("version", clean_hash(F.col("sha256")))


def process_new(versions: DataFrame, ledger: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run work once on each (rel_path, version) of a batch that the ledger (a parquet folder) lacks, then append them to it.

    A batch that is run again after a failure finds what it had finished in the ledger. The
    ledger of a batch is one folder named by it, overwritten if the batch is repeated.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates(["rel_path", "version"])
        try:
            done = spark.read.parquet(ledger).where(F.col("batch") != number).select("rel_path", "version")
            rows = rows.join(done, ["rel_path", "version"], "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(rows).select("rel_path", "version").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return versions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each window, late events within the watermark included; the same on a table and on a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n of each session: events of a user with no gap of that length."""
    rows = events.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")
