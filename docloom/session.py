"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a shared or equal path; else install it or pass --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, which the cluster names in spark.checkpoint.dir. Only on a local master, where driver and executors share a disk, may it be unset: then a temporary folder is used."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not named and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        # Checkpoints go when the frames that wrote them are gone.
        own = sc._jsc.sc().conf()
        if not own.contains(_CLEAN):
            own.set(_CLEAN, "true")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "docloom-checkpoints"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and continue from there: lineage ends, lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
