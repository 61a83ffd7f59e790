"""Search over lines of text with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line."""
    return df.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def hits(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that match a regular expression, whatever the case; texts without a match are dropped before they are cut into lines."""
    found = F.col(text).rlike(f"(?iu){pattern}")
    return lines(df.where(found), key, text).where(F.col("line").rlike(f"(?iu){pattern}"))


def hits_in_context(df: DataFrame, key: str, text: str, pattern: str, around: int = 3) -> DataFrame:
    """key, line_no, line, is_hit: hits and the lines around them, inside each text, without a shuffle."""
    rows = df.where(F.col(text).rlike(f"(?iu){pattern}")).select(F.col(key), F.split(text, "\n").alias("all"))
    marked = rows.withColumn("hit", F.transform("all", lambda s: s.rlike(f"(?iu){pattern}")))
    near = F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.exists(F.slice("hit", F.greatest(i - around, F.lit(1)), around + F.least(i, F.lit(around + 1))), lambda h: h))
    out = marked.select(key, F.posexplode(F.arrays_zip("all", "hit", near.alias("near"))).alias("i", "x"))
    return out.where("x.near").select(key, (F.col("i") + 1).alias("line_no"), F.col("x.all").alias("line"), F.col("x.hit").alias("is_hit"))
