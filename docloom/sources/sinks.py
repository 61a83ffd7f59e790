"""Where results go: transcripts, aggregates that changed, the call log."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import OWN_TYPES, RESERVED_NAMES
from docloom.operators.folders import changed_rows
from docloom.sources.okf import parse_document
from docloom.sources.state import load_state, save_state  # noqa: F401


def missing_transcripts(files: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Files without a transcript."""
    return files.join(transcripts.select("rel_path").distinct(), "rel_path", "left_anti")


def write_changed(new: DataFrame, folder: str, key: str, value: str, run: str) -> int:
    """Write to a parquet folder, as partition run=.., the rows that its newest version of other runs lacks; the number written (K6).

    A run that is repeated compares with what was there before it, and replaces its own
    partition: nothing is lost or doubled. Runs are ordered by name.
    """
    spark: SparkSession = new.sparkSession
    try:
        before = spark.read.option("basePath", folder).parquet(folder).where(F.col("run").cast("string") < run)
        old = before.groupBy(key).agg(F.max_by(value, F.col("run").cast("string")).alias(value))
        new = changed_rows(new, old, key, value)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    new.write.mode("overwrite").parquet(f"{folder}/run={run}")
    return spark.read.parquet(f"{folder}/run={run}").count()


def write_texts(texts: DataFrame, root: str) -> int:
    """Write each content to its path below a shared root, by tasks; files that hold it already are left alone. The number written.

    texts: path, content. A file appears whole or not at all, so a repeated task does no harm.
    """

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = 0
            for path, content in zip(part["path"], part["content"], strict=True):
                target = os.path.join(root, path)
                data = (content or "").encode("utf-8")
                try:
                    with open(target, "rb") as f:
                        if f.read() == data:
                            continue
                except OSError:
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                with open(draft, "wb") as f:
                    f.write(data)
                os.replace(draft, target)
                n += 1
            yield pd.DataFrame({"n": [n]})

    return texts.select("path", "content").mapInPandas(go, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def delete_own(paths: DataFrame, root: str, types: tuple[str, ...] = OWN_TYPES) -> int:
    """Delete the files at these paths that are aggregates of this engine; reserved names and files written by hand stay (K5, F14). The number deleted."""

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = 0
            for path in part["path"]:
                target = os.path.join(root, path)
                try:
                    with open(target, encoding="utf-8") as f:
                        kind = parse_document(f.read()).get("type")
                except (OSError, UnicodeDecodeError):
                    continue
                if kind in types and os.path.basename(path) not in RESERVED_NAMES:
                    os.remove(target)
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return paths.select("path").mapInPandas(go, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def append_calls(calls: DataFrame, folder: str) -> None:
    """Calls as lines of JSON."""
    calls.write.mode("append").json(folder)


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    schema = "timestamp timestamp, model string, host string, prompt_chars int, payload_bytes int, duration_ms bigint, attempts int, success boolean, error string"
    return spark.read.schema(schema).json(folder)
