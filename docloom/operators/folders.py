"""Folder aggregates and roll-up indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.gating import is_hidden
from docloom.functions.text import FLAG_MARKER, base_name, parent


def newest_versions(concepts: DataFrame) -> DataFrame:
    """The version of each path that was loaded last, the greatest concept_id among equals; partially aggregated, so a hot path costs nothing."""
    columns = [c for c in concepts.columns if c != "path"]
    newest = concepts.where(F.col("path").isNotNull()).groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("loaded_at", "concept_id")).alias("x"))
    return newest.select("path", "x.*")


def ancestors(folder: Column) -> Column:
    """The folder and every folder above it, without the root."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def folder_tree(folders: DataFrame, folder: str) -> DataFrame:
    """folder, parent, depth of every visible folder that holds something, directly or below."""
    every = folders.where(F.coalesce(F.col(folder), F.lit("")) != "").select(folder).distinct()
    every = every.select(F.explode(ancestors(F.col(folder))).alias("folder")).distinct().where(~is_hidden(F.col("folder")))
    return every.select("folder", parent(F.col("folder")).alias("parent"), F.size(F.split("folder", "/")).alias("depth"))


def rollup_links(tree: DataFrame, descriptions: DataFrame) -> DataFrame:
    """folder, n_children, links: the lines that lead from a folder to its children (P10, J9). descriptions: folder, description."""
    children = tree.join(descriptions, "folder", "left").select(
        F.col("parent").alias("folder"), F.col("folder").alias("child"), F.coalesce(F.nullif("description", F.lit("")), base_name(F.col("folder"))).alias("text")
    )
    name = base_name(F.col("child"))
    line = F.concat(F.lit("- ["), name, F.lit("]("), name, F.lit("/"), name, F.lit(".md) — "), F.col("text"))
    rows = children.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n_children"), F.array_sort(F.collect_list(F.struct("child", line.alias("line")))).alias("rows"))
    return rows.select("folder", "n_children", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("links"))


def without_rollup(body: Column) -> Column:
    """The body without its section of sub-folders."""
    return F.regexp_replace(body, r"(?s)(?:^|\n+)## Subfolders\n.*?(?=\n## |\z)", "")


def with_rollup(body: Column, links: Column) -> Column:
    return F.concat(F.rtrim(without_rollup(body)), F.lit("\n\n## Subfolders\n\n"), links)


def folder_totals(df: DataFrame, folder: str, text: str) -> DataFrame:
    """folder, n_documents, n_chars, density: characters a document."""
    return df.groupBy(folder).agg(F.count("*").alias("n_documents"), F.sum(F.length(text)).alias("n_chars")).withColumn("density", F.col("n_chars") / F.col("n_documents"))


def folder_bodies(sections: DataFrame, folder: str, order: str, section: str) -> DataFrame:
    """folder, n_sections, body: sections joined in order (A1). A folder is a document of its own, so it must fit one; a source that is larger is a table, not a folder."""
    rows = sections.groupBy(folder).agg(F.count("*").alias("n_sections"), F.array_sort(F.collect_list(F.struct(order, section))).alias("rows"))
    return rows.select(folder, "n_sections", F.array_join(F.transform("rows", lambda r: r[section]), "\n\n").alias("body"))


def navigation_stats(concepts: DataFrame) -> DataFrame:
    """One row: folders, documents, flagged, matters, has_synthesis of the visible concepts."""
    summary = F.col("okf_type") == "FolderSummary"
    return concepts.where(~is_hidden(F.col("path"))).agg(
        F.count_if(summary).alias("folders"),
        F.coalesce(F.sum(F.when(summary, F.size(F.coalesce("sources", F.array().cast("array<string>"))))), F.lit(0)).cast("long").alias("documents"),
        F.coalesce(F.sum(F.when(summary, F.regexp_count("body", F.lit(FLAG_MARKER)))), F.lit(0)).cast("long").alias("flagged"),
        F.count_if((F.col("okf_type") == "Matter")).alias("matters"),
        F.coalesce(F.bool_or(F.col("okf_type") == "Synthesis"), F.lit(False)).alias("has_synthesis"),
    )


def orphans(aggregates: DataFrame, live: DataFrame) -> DataFrame:
    """folder of own aggregates whose folder holds no file any more."""
    return aggregates.select("folder").distinct().join(live.select("folder").distinct(), "folder", "left_anti")


def changed_rows(new: DataFrame, old: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of new whose key is not in old or has another value: what must be written (K6)."""
    known = old.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return new.join(known, (F.col(key) == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left_anti")


def exit_code(skipped: Column, flagged: Column, bad_root: Column | None = None) -> Column:
    """1 for a bad root, 2 if anything was skipped or flagged, else 0."""
    return F.when(bad_root if bad_root is not None else F.lit(False), 1).when((skipped > 0) | (flagged > 0), 2).otherwise(0)
