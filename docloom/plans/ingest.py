"""Ingest of a tree of files into folder aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import FLAG_MARKER, base_name, default_title, folder_summary_path, section
from docloom.operators import extraction, folders, merging, validation
from docloom.operators.extraction import Extractor, Verifier, rule_extractor, rule_verifier
from docloom.plans.config import Config
from docloom.session import cut
from docloom.sources import sinks
from docloom.sources.files import gated, list_files, read_texts
from docloom.sources.okf import render_document

STATE = "rel_path string, folder string, name string, sha256 string, section string, passed boolean, tags array<string>, identifiers map<string,array<string>>, facts string"
SUMMARIES = "folder string, source_hash string, summary string"
#: sections of a folder -> some sentences about it
Summarizer = Callable[[str], str]
OWN = ".docloom"
FAILED_STUB = f"{FLAG_MARKER} — no source of this folder could be read in the last run_"


def rule_summary(sections: str) -> str:
    """Deterministic default: the headings of the sections."""
    heads = [line[3:] for line in sections.split("\n") if line.startswith("## ")]
    return f"{len(heads)} document(s): {'; '.join(heads)}." if heads else ""


@dataclass
class Ingested:
    """One run.

    aggregates: folder, n_sections, body; documents: path, content of every aggregate and
    index as it is to be written; state and summaries: what the next run compares with;
    skipped: rel_path, reason; transcripts: rel_path, text; orphans: path of aggregates
    whose folder holds nothing any more; n_derived, n_summaries: calls for texts and folders
    that were new or changed; n_flagged: aggregates with a failed check or section.
    """

    aggregates: DataFrame
    documents: DataFrame
    state: DataFrame
    summaries: DataFrame
    skipped: DataFrame
    transcripts: DataFrame
    orphans: DataFrame
    n_derived: int
    n_summaries: int
    n_flagged: int


def ingest(
    spark: SparkSession, root: str, config: Config | None = None, state: DataFrame | None = None, extractor: Extractor = rule_extractor, verifier: Verifier = rule_verifier, force: bool = False,
    summaries: DataFrame | None = None, summarizer: Summarizer = rule_summary, readers: dict | None = None,
) -> Ingested:
    """One run: walk, gate, read, compare with the last state, derive what is new or changed, verify, summarise changed folders, and make each folder's document.

    A file with the hash it had keeps its section. A file whose derivation fails keeps its
    old section and old hash, so the next run tries again. Deleted files leave the state. A
    folder that had an aggregate and of whose files none could be read now gets a flagged
    stub (V10). Nothing is written here: see write().
    """
    config = config or Config(document_root=root)
    known = spark.createDataFrame([], STATE) if state is None or force else state
    told = spark.createDataFrame([], SUMMARIES) if summaries is None or force else summaries
    files, skipped = gated(list_files(spark, root), config.gates)
    read = cut(read_texts(files, root, readers))
    good = read.where("error is null")
    same = good.join(known.select("rel_path", "sha256"), ["rel_path", "sha256"], "left_semi")
    work = good.join(same.select("rel_path"), "rel_path", "left_anti")
    parts = cut(extraction.derive(work.select("rel_path", "text"), "rel_path", "text", extractor, config.chunk_threshold, config.chunk_overlap))
    broken = parts.where("error is not null").groupBy("rel_path").agg(F.first("error").alias("reason"))
    usable = parts.join(broken, "rel_path", "left_anti")
    merged = merging.merge_parts(usable, "rel_path", "chunk_no", {"title": "first", "description": "first", "tags": "tags", "body": "body"})
    merged = merged.join(merging.identifier_union(usable, "rel_path", "identifiers"), "rel_path", "left")
    derived = merged.join(work.select("rel_path", "folder", "name", "sha256", "text"), "rel_path")
    verdicts = cut(extraction.verify(derived, "rel_path", "text", "body", verifier))
    issue = F.when(~F.col("passed"), F.col("reason"))
    title = default_title(F.col("title"), F.col("rel_path"))
    facts = render_document({"type": F.lit("Fact"), "title": title, "description": F.col("description"), "list:tags": F.col("tags"), "source": F.col("rel_path"), "lists:identifiers": F.col("identifiers")}, F.col("body"))
    fresh = derived.join(verdicts, "rel_path").select("rel_path", "folder", "name", "sha256", section(title, F.col("name"), issue, F.col("body")).alias("section"), "passed", "tags", "identifiers", facts.alias("facts"))
    failing = read.where("error is not null").select("rel_path", "folder", F.col("error").alias("reason")).unionByName(broken.join(work.select("rel_path", "folder"), "rel_path").select("rel_path", "folder", "reason"))
    kept = known.join(same.select("rel_path").unionByName(failing.select("rel_path")), "rel_path", "left_semi")
    now = cut(fresh.unionByName(kept))
    aggregates = cut(folders.folder_bodies(now, "folder", "name", "section").withColumn("source_hash", F.sha2("body", 256)))
    stale = aggregates.join(told.select("folder", "source_hash"), ["folder", "source_hash"], "left_anti")
    new_summaries = cut(extraction.replies(stale, "folder", "body", summarizer).select("folder", F.col("reply").alias("summary")))
    all_summaries = cut(
        stale.join(new_summaries, "folder").select("folder", "source_hash", "summary")
        .unionByName(told.join(aggregates.select("folder", "source_hash"), ["folder", "source_hash"], "left_semi").select("folder", "source_hash", "summary"))
    )
    had = known.select("folder").distinct()
    emptied = failing.select("folder").distinct().join(now.select("folder"), "folder", "left_anti").join(had, "folder", "left_semi")
    documents, n_flagged = folder_documents(now, aggregates, all_summaries, emptied)
    live = now.select("folder").unionByName(emptied).where("folder <> ''")
    trees = lambda rows: folders.folder_tree(rows, "folder").select("folder")
    orphans = trees(had.where("folder <> ''")).join(trees(live), "folder", "left_anti").select(folder_summary_path(F.col("folder")).alias("path"))
    reasons = skipped.unionByName(failing.select("rel_path", "reason"))
    return Ingested(aggregates.drop("source_hash"), documents, now, all_summaries, reasons, good.select("rel_path", "text"), orphans, work.count(), new_summaries.count(), n_flagged)


def folder_documents(state: DataFrame, aggregates: DataFrame, summaries: DataFrame, emptied: DataFrame) -> tuple[DataFrame, int]:
    """(path, content of every folder with files or with such folders below it, number of flagged ones).

    A folder of files is a FolderSummary: its summary, its sections, links to the folders
    below it. One that only has folders below it is a FolderIndex of links. All levels are
    made at once: a folder belongs to the tree if any folder below it holds files, which is
    told by the paths alone, so nothing has to be visited from the deepest up (O2).
    """
    inside = aggregates.where("folder <> ''")
    per = state.where("folder <> ''").groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("name", "rel_path", "sha256"))).alias("files"))
    per = per.join(merging.ordered_values(state.where("folder <> ''"), "folder", "name", "tags"), "folder", "left")
    ids = merging.identifier_union(state.where("folder <> ''"), "folder", "identifiers")
    tree = cut(folders.folder_tree(inside.select("folder").unionByName(emptied.where("folder <> ''")), "folder"))
    said = F.format_string("Aggregated extraction of %d document(s) in %s", F.col("n_sections"), base_name(F.col("folder")))
    described = tree.join(inside.select("folder", "n_sections"), "folder", "left").select("folder", F.when(F.col("n_sections").isNotNull(), said).otherwise(F.format_string("Index of the folders in %s", base_name(F.col("folder")))).alias("description"))
    links = folders.rollup_links(tree, described)
    rows = tree.join(described, "folder").join(inside, "folder", "left").join(summaries.select("folder", "summary"), "folder", "left").join(per, "folder", "left").join(ids, "folder", "left").join(links.select("folder", "links"), "folder", "left")
    rows = rows.join(emptied.select("folder", F.lit(True).alias("emptied")), "folder", "left")
    text = F.concat_ws("\n\n", F.nullif("summary", F.lit("")), F.col("body"), F.when(F.col("emptied"), F.lit(FAILED_STUB)))
    full = F.when(F.col("links").isNotNull(), folders.with_rollup(text, F.col("links"))).otherwise(text)
    sources = F.transform("files", lambda f: f["rel_path"])
    made = rows.select(
        folder_summary_path(F.col("folder")).alias("path"), F.when(F.col("body").isNotNull() | F.col("emptied"), "FolderSummary").otherwise("FolderIndex").alias("okf_type"), base_name(F.col("folder")).alias("title"), "description", "tags",
        F.coalesce(sources, F.array().cast("array<string>")).alias("sources"), F.map_from_entries(F.transform("files", lambda f: F.struct(f["name"], f["sha256"]))).alias("source_hashes"), "identifiers", full.alias("body"), F.coalesce("emptied", F.lit(False)).alias("emptied"),
    ).withColumn("concept_id", F.col("path"))
    reports = validation.report(validation.findings(made.where("not emptied")))
    done = cut(validation.with_banner(made, reports))
    fields = {"type": F.col("okf_type"), "title": F.col("title"), "description": F.col("description"), "list:tags": F.col("tags"), "list:sources": F.col("sources"), "map:source_hashes": F.col("source_hashes"), "lists:identifiers": F.col("identifiers")}
    n_flagged = done.where(F.contains("body", F.lit(FLAG_MARKER))).count()
    return done.select("path", render_document(fields, F.col("body")).alias("content")), n_flagged


def write(done: Ingested, root: str, config: Config | None = None) -> dict[str, int]:
    """Put a run on the shared disk: transcripts, facts if derive_per_file is set, documents that changed, orphans removed, and last the state, so that a run that fails before is simply run again. Counts of what was written."""
    kept = f"{root}/{OWN}"
    counts = {"transcripts": sinks.write_texts(done.transcripts.select(F.concat(F.lit("transcripts/"), "rel_path", F.lit(".txt")).alias("path"), F.col("text").alias("content")), kept)}
    if config and config.derive_per_file:
        counts["facts"] = sinks.write_texts(done.state.where("facts is not null").select(F.concat(F.lit("facts/"), "rel_path", F.lit(".md")).alias("path"), F.col("facts").alias("content")), kept)
    counts["documents"] = sinks.write_texts(done.documents, root)
    counts["deleted"] = sinks.delete_own(done.orphans, root)
    sinks.save_state(done.summaries, f"{kept}/summaries")
    sinks.save_state(done.state, f"{kept}/state")
    return counts


def run(spark: SparkSession, root: str, config: Config | None = None, force: bool = False, **models) -> tuple[Ingested, dict[str, int]]:
    """Ingest a tree against the state it keeps, and write the result."""
    kept = f"{root}/{OWN}"
    done = ingest(spark, root, config, sinks.load_state(spark, f"{kept}/state"), force=force, summaries=sinks.load_state(spark, f"{kept}/summaries"), **models)
    return done, write(done, root, config)
