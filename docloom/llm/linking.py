"""Problem 4 on concepts: paths linked by identifier values or source paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import contract

# Fixed values of the problem statement.
NEVER_LINKING_KEYS = ("kontakt", "telefon", "anschrift", "sonstiges")
LEAST_CHARS = 6
LEAST_DIGITS = 5


def vertex(kind: str, value: Column) -> Column:
    """128-bit vertex id: short to shuffle, and free of collisions for billions of vertices."""
    return F.unhex(F.md5(F.concat(F.lit(kind), value)))


def identifier_value(value: Column) -> Column:
    """The comparable form of an identifier value, or null if it can't link."""
    bare = F.lower(F.regexp_replace(value, r"(?U)[\s./\-]", ""))
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    differ = F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) > 0
    return F.when((F.length(bare) >= LEAST_CHARS) & (F.length(digits) >= LEAST_DIGITS) & differ, bare)


def source_path(value: Column) -> Column:
    """The comparable form of a source path."""
    return F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), r"^\./", "")


def concept_links(concepts: DataFrame) -> DataFrame:
    """Bipartite edges (a: vertex of a path, b: vertex of something it holds). Null paths, maps, lists and values hold nothing."""
    held = concepts.where(F.col("path").isNotNull()).select("path", "identifiers", "sources")
    keep = F.map_filter("identifiers", lambda k, _: ~k.isin(*NEVER_LINKING_KEYS))
    lists = F.transform(F.map_values(keep), lambda vs: F.coalesce(vs, F.array().cast("array<string>")))
    ids = F.transform(F.flatten(lists), lambda v: vertex("i:", identifier_value(v)))
    paths = F.transform("sources", lambda s: vertex("s:", source_path(s)))
    empty = F.array().cast("array<binary>")
    every = F.array_compact(F.concat(F.coalesce(ids, empty), F.coalesce(paths, empty)))
    return held.select(vertex("p:", F.col("path")).alias("a"), F.explode(every).alias("b")).distinct()


def concept_groups(concepts: DataFrame) -> DataFrame:
    """path, group_path, group_size for each distinct non-null path of concepts; a path with no link is a group of its own.

    group_path is the smallest path of the group in code point order, which is the byte
    order of UTF-8 that Spark compares strings by.
    """
    nodes = concepts.where(F.col("path").isNotNull()).select("path").distinct().withColumn("vertex", vertex("p:", F.col("path")))
    labelled = nodes.join(contract(concept_links(concepts)), "vertex", "left").select("path", F.coalesce("label", "vertex").alias("label"))
    groups = labelled.groupBy("label").agg(F.min("path").alias("group_path"), F.count("*").alias("group_size"))
    return labelled.join(groups, "label").select("path", "group_path", "group_size")
