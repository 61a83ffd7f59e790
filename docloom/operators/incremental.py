"""Change detection: which files still need processing (J1, J2, I1-I3, I6 and problem 5).

Method: a run keeps the newest version of every file it knows. The next run reads again only
what was loaded since the oldest transaction that was open at that run, puts it over what is
known, and removes what was done by an anti-join of (key, version) pairs against the ledger
of processed pairs. What is known holds the backlog too: files whose processing failed, or
whose folder's baseline forgot them, stay pending although they are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.state import load_state, save_state


def clean_path(path: Column) -> Column:
    """A path with / as separator and without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def clean_hash(value: Column) -> Column:
    """A hash in lower case without its sha256: prefix."""
    return F.regexp_replace(F.lower(value), r"^sha256:", "")


def current_versions(files: DataFrame) -> DataFrame:
    """Newest readable scan of each file: rel_path, folder, name, version, scanned_at, loaded_at.

    Rows without path or hash are ignored. Of scans at the same instant the greatest hash
    wins, so repeated rows and ties give one defined row. A null scanned_at is oldest.
    The maximum is partially aggregated before the shuffle: a hot folder costs nothing.
    """
    readable = files.where(F.col("rel_path").isNotNull() & F.col("sha256").isNotNull())
    return _newest(readable.select(clean_path(F.col("rel_path")).alias("rel_path"), "folder", "name", clean_hash(F.col("sha256")).alias("version"), "scanned_at", "loaded_at"))


def _newest(scans: DataFrame) -> DataFrame:
    best = scans.groupBy("rel_path").agg(F.max(F.struct("scanned_at", "version", "folder", "name", "loaded_at")).alias("scan"))
    return best.select("rel_path", "scan.folder", "scan.name", "scan.version", "scan.scanned_at", "scan.loaded_at")


def known_versions(known: DataFrame, files: DataFrame, bound: str | None) -> DataFrame:
    """What was known, with the scans loaded from `bound` on put over it; without a bound, all scans. The bound is a literal, so that it reaches the scan of files."""
    loaded = F.col("loaded_at")
    reread = files if bound is None else files.where(loaded.isNull() | (loaded >= F.lit(bound).cast(files.schema["loaded_at"].dataType)))
    return _newest(known.unionByName(current_versions(reread)))


def successful_runs(runs: DataFrame) -> DataFrame:
    """Distinct run_id that have an attempt with status success."""
    return runs.where(F.col("status") == "success").select("run_id").distinct()


def baselines(concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest FolderSummary of each folder written by a successful run: folder, sources, source_hashes.

    Rows without stamped_at or folder can't be a baseline. Of rows stamped at the same
    instant the one loaded last wins, then the greatest concept_id.
    """
    summaries = concepts.where((F.col("okf_type") == "FolderSummary") & F.col("stamped_at").isNotNull() & F.col("folder").isNotNull()).select(
        "folder", "run_id", "stamped_at", "loaded_at", "concept_id", "sources", "source_hashes"
    )
    return (
        summaries.join(successful_runs(runs), "run_id", "left_semi")
        .groupBy("folder")
        .agg(F.max_by(F.struct("sources", "source_hashes"), F.struct("stamped_at", "loaded_at", "concept_id")).alias("b"))
        .select("folder", "b.sources", "b.source_hashes")
    )


def ledger(bases: DataFrame) -> DataFrame:
    """Processed (folder, rel_path) of the baselines with the version on record (null: none): folder, rel_path, done_version."""
    listed = bases.select("folder", "source_hashes", F.explode("sources").alias("source")).where(F.col("source").isNotNull())
    name = F.element_at(F.split("source", "/"), -1)
    return (
        listed.withColumn("source", clean_path(F.col("source")))
        .select("folder", F.col("source").alias("rel_path"), clean_hash(F.try_element_at("source_hashes", name)).alias("done_version"))
        .groupBy("folder", "rel_path")
        .agg(F.max("done_version").alias("done_version"))
    )


def reread_bound(runs: DataFrame) -> DataFrame:
    """One row: reread_from, the start of the oldest attempt still open when the last successful attempt started (that attempt itself included); null if none ever succeeded."""
    last = runs.where(F.col("status") == "success").agg(F.max("started_at").alias("last_start"))
    still_open = (F.col("started_at") <= F.col("last_start")) & (F.col("finished_at").isNull() | (F.col("finished_at") >= F.col("last_start")))
    return runs.crossJoin(F.broadcast(last)).where(still_open).agg(F.min("started_at").alias("reread_from"))


def _bound(runs: DataFrame) -> str | None:
    """The bound as text in the session's time zone, so that no other zone takes part in it."""
    return reread_bound(runs).select(F.col("reread_from").cast("string")).first()[0]


def pending(now: DataFrame, concepts: DataFrame, runs: DataFrame, bound: str | None) -> DataFrame:
    """Known versions that are in no successful baseline: see pending_files."""
    done = ledger(baselines(concepts, runs))
    # The anti-join of (key, version) against the ledger, as an outer join that also tells an unknown key from a changed version.
    joined = now.alias("n").join(done.alias("d"), (F.col("n.folder") == F.col("d.folder")) & (F.col("n.rel_path") == F.col("d.rel_path")), "left")
    open_ = joined.where(F.col("d.rel_path").isNull() | ~F.col("n.version").eqNullSafe(F.col("d.done_version")))
    again = F.lit(True) if bound is None else F.coalesce(F.col("n.loaded_at") >= F.lit(bound).cast(now.schema["loaded_at"].dataType), F.lit(False))
    return open_.select(
        F.col("n.rel_path").alias("rel_path"),
        F.col("n.folder").alias("folder"),
        F.col("n.version").alias("version"),
        F.when(F.col("d.rel_path").isNull(), "new").otherwise("changed").alias("change"),
        F.when(again, "reread").otherwise("backlog").alias("part"),
    )


def pending_files(files: DataFrame, concepts: DataFrame, runs: DataFrame) -> DataFrame:
    """Files whose current version is in no successful baseline, without a kept state.

    Columns: rel_path, folder, version, change ('new': not listed by the folder's
    baseline, 'changed': listed with no or another hash) and part ('reread': loaded since
    the oldest transaction open at the last run; 'backlog': loaded before, still pending).
    What a kept state would hold is made from the scans loaded before the bound; the rest is
    the same run. Empty tables: no files give no rows; no runs or concepts make every file
    new. Other columns of the inputs, whatever their names, are never read.
    """
    bound = _bound(runs)
    before = files.where(F.lit(False)) if bound is None else files.where(F.col("loaded_at") < F.lit(bound).cast(files.schema["loaded_at"].dataType))
    return pending(known_versions(current_versions(before), files, bound), concepts, runs, bound)


@dataclass
class PendingRun:
    """One incremental run: pending as of pending_files; known: the newest version of every file; bound: from where the next run must read again."""

    pending: DataFrame
    known: DataFrame
    bound: str | None


def pending_since(files: DataFrame, concepts: DataFrame, runs: DataFrame, folder: str) -> PendingRun:
    """What needs processing, reading only scans loaded since the oldest transaction open when the state in `folder` was kept (all of them without a state).

    Call keep() after the work of the run is done: until then a run that fails is repeated
    from the same state.
    """
    spark = files.sparkSession
    kept, since = load_state(spark, f"{folder}/known"), load_state(spark, f"{folder}/bound")
    bound = since.first()["bound"] if since is not None and kept is not None else None
    empty = current_versions(files.where(F.lit(False)))
    known = known_versions(kept if bound is not None else empty, files, bound)
    return PendingRun(pending(known, concepts, runs, bound), known, _bound(runs))


def keep(done: PendingRun, folder: str) -> None:
    """Keep what a finished run knows. The versions come first: a failure between the two keeps the older bound, which only makes the next run read more."""
    save_state(done.known, f"{folder}/known")
    save_state(done.known.sparkSession.createDataFrame([(done.bound,)], "bound string"), f"{folder}/bound")
