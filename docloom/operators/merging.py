"""Merging what was derived from parts: ordered unions, first values, maps of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_union(order: Column, values: Column) -> Column:
    """Aggregate: the different values of ordered arrays by first appearance (A3)."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(values, F.array().cast("array<string>")).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["v"])))


def ordered_values(df: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """key, values: the different values of a group's ordered arrays by first appearance (A3), deduplicated before they are gathered: a group holds its different values, however many rows it has. Nulls are values no more."""
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.posexplode(values).alias("i", "v")).where("v is not null")
    first = rows.groupBy("k", "v").agg(F.min(F.struct("o", "i")).alias("at"))
    lists = first.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("rows"))
    return lists.select(F.col("k").alias(key), F.transform("rows", lambda r: r["v"]).alias(values))


def first_filled(order: Column, value: Column) -> Column:
    """Aggregate: the first value that is neither null nor empty (A4)."""
    return F.min_by(F.nullif(value, F.lit("")), F.when(F.coalesce(value, F.lit("")) != "", order))


def joined_bodies(order: Column, body: Column) -> Column:
    """Aggregate: bodies that are not blank, in order, with a blank line between (A1, A5)."""
    kept = F.when(F.trim(body) != "", F.struct(order.alias("o"), body.alias("b")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda r: r["b"]), "\n\n")


def identifier_values(df: DataFrame, key: str, identifiers: str) -> DataFrame:
    """key, label, value: the different non-empty values of maps of lists (A2)."""
    labels = df.select(F.col(key).alias("k"), F.explode(identifiers).alias("label", "values"))
    values = labels.select("k", "label", F.explode("values").alias("value")).where(F.coalesce("value", F.lit("")) != "")
    return values.distinct().withColumnRenamed("k", key)


def identifier_union(df: DataFrame, key: str, identifiers: str) -> DataFrame:
    """key, identifiers: one map a key, labels and values sorted, no empty ones (A2). Values are deduplicated before they are gathered."""
    lists = identifier_values(df, key, identifiers).groupBy(key, "label").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "values")))).alias("identifiers"))


def merge_parts(df: DataFrame, key: str, order: str, columns: dict[str, str]) -> DataFrame:
    """One row a key of the documents derived from its parts (A5).

    columns: how each is merged: first (first filled), tags (ordered union), body (joined)
    or head (value of the first part).
    """
    by = F.col(order)
    how = {"first": first_filled, "tags": ordered_union, "body": joined_bodies, "head": lambda o, v: F.min_by(v, o)}
    return df.groupBy(key).agg(*(how[kind](by, F.col(c)).alias(c) for c, kind in columns.items()))
