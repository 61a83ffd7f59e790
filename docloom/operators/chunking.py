"""Chunks of long texts with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 8000
OVERLAP = 500


def chunk_bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ends after the last line end or blank of a window if that is in its last three quarters; the next window begins `overlap` before."""
    start, least = 0, max(1, int(size * 0.25))
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            last = max(text.rfind("\n", start, end), text.rfind(" ", start, end)) - start
            if last >= least:
                end = start + last + 1
        yield start, end
        if end >= len(text):
            return
        start = end - overlap if end - overlap > start else end


def chunks(df: DataFrame, key: str, text: str, threshold: int = THRESHOLD, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_no (from 1), n_chunks, chunk; a text within the threshold is one chunk, a null text none.

    Short texts stay in the JVM; only those beyond the threshold go through Arrow.
    """
    if threshold <= 0 or not 0 <= overlap < threshold:
        raise ValueError("threshold must be positive and overlap at least 0 and less than it")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    short = rows.where(F.length("t") <= threshold).select("k", F.lit(1).alias("chunk_no"), F.lit(1).alias("n_chunks"), F.col("t").alias("chunk"))
    kind = rows.schema["k"].dataType.simpleString()

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, t in enumerate(part.column(1).to_pylist()):
                bounds = list(chunk_bounds(t, threshold, overlap))
                n = len(bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([i] * n, pa.int64())), pa.array(range(1, n + 1), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([t[a:b] for a, b in bounds])],
                    names=["k", "chunk_no", "n_chunks", "chunk"],
                )

    long = rows.where(F.length("t") > threshold).mapInArrow(go, f"k {kind}, chunk_no int, n_chunks int, chunk string")
    return short.unionByName(long).withColumnRenamed("k", key)


def chunk_context(path, chunk_no, n_chunks):
    """Label of a chunk: the path, with part i/n if there are several."""
    return F.when(n_chunks > 1, F.concat(path, F.lit(" (part "), chunk_no.cast("string"), F.lit("/"), n_chunks.cast("string"), F.lit(")"))).otherwise(path)
