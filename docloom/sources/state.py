"""State that a run keeps for the next one, as numbered versions on a shared disk."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession


def save_state(frame: DataFrame, folder: str, keep: int = 2) -> str:
    """Write a frame as the next numbered version below a folder on a shared disk, then name it current by one atomic rename; older versions beyond `keep` go. Whatever fails before the rename, the last version stays the current one."""
    numbers = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    version = f"{max(numbers, default=0) + 1:08d}"
    frame.write.mode("overwrite").parquet(f"{folder}/{version}")
    with open(f"{folder}/.current.part", "w") as f:
        f.write(version)
    os.replace(f"{folder}/.current.part", f"{folder}/.current")
    for n in sorted(numbers)[: -keep or None]:
        shutil.rmtree(f"{folder}/{n:08d}", ignore_errors=True)
    return version


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current version below a folder, or None."""
    try:
        with open(f"{folder}/.current") as f:
            return spark.read.parquet(f"{folder}/{f.read().strip()}")
    except FileNotFoundError:
        return None
