"""Plausibility checks of aggregates and matters (V1-V9, A7-A10, J4-J7, P20); V10 is in plans/ingest.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.gating import is_hidden
from docloom.functions.text import base_name, blocks, cited_sources, normal_block
from docloom.operators.tokens import labelled_identifiers

LEAST_DENSITY = 80
LEAST_BLOCK = 40
MOST_EVIDENCE = 8

# What a body must not hold.
LEAKED_TYPE = r"(?mdU)^type:\s*\S+\s*$"
OPEN_FIELD = r"(?imdU)^\s*(title|description|tags|source|timestamp):\s*(?:\.\.\.|\[\.\.\.\]|path/to/)"
META_PHRASES = ("here is the output", "here's the output", "in valid okf", "as an ai", "focus on quality over quantity")


def _finding(check: str, passed: Column, evidence: Column) -> Column:
    return F.struct(F.lit(check).alias("check_id"), passed.alias("passed"), F.when(passed, "").otherwise(evidence).alias("evidence"))


def _listed(missing: Column) -> Column:
    """The first eight, and how many more there are."""
    more = F.when(F.size(missing) > MOST_EVIDENCE, F.concat(F.lit(" (+"), (F.size(missing) - MOST_EVIDENCE).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(missing, 1, MOST_EVIDENCE), ", "), more)


def missing_citations(sources: Column, cited: Column) -> Column:
    """Sources whose name is not among the cited ones."""
    return F.filter(sources, lambda s: ~F.array_contains(cited, base_name(s)))


def missing_references(sources: Column, body: Column) -> Column:
    """Sources that the body of a matter does not name."""
    return F.filter(sources, lambda s: ~F.contains(body, s))


def long_blocks(body: Column) -> Column:
    """Normal blocks of at least 40 characters."""
    return F.filter(F.transform(blocks(body), normal_block), lambda b: F.length(b) >= LEAST_BLOCK)


def repeated_block(normal: Column) -> Column:
    """The first of the blocks that stands more than twice, or null (V6): in sorted order it equals the next but one."""
    ordered = F.array_sort(normal)
    many = F.size(normal) > 2
    pairs = F.arrays_zip(F.slice(ordered, F.lit(1), F.greatest(F.size(normal) - 2, F.lit(0))).alias("a"), F.slice(ordered, F.lit(3), F.greatest(F.size(normal) - 2, F.lit(0))).alias("b"))
    again = F.array_distinct(F.transform(F.filter(pairs, lambda p: p["a"] == p["b"]), lambda p: p["a"]))
    return F.when(many, F.array_min(F.transform(again, lambda x: F.struct(F.array_position(normal, x).alias("at"), x.alias("block"))))["block"])


def findings(concepts: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """concept_id, path, check_id, passed, evidence of every visible FolderSummary and Matter: checks V1 to V7, all in one projection of the row.

    Given transcripts (rel_path, text), FolderSummaries with a source that has one are also
    checked for lost identifiers (V8). A row without sources has no density check. Null lists
    count as empty, a null body as ''; a null path is visible.
    """
    visible = ~F.coalesce(is_hidden(F.col("path")), F.lit(False))
    rows = concepts.where(F.col("okf_type").isin("FolderSummary", "Matter") & visible).select(
        "concept_id", "path", "okf_type", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("body", F.lit("")).alias("body")
    )
    # Made once a row: inside a lambda they would be made again for each element.
    rows = rows.withColumns({"_blocks": long_blocks(F.col("body")), "_cited": cited_sources(F.col("body"))})
    summary = F.col("okf_type") == "FolderSummary"
    n = F.size("sources")
    missing = F.when(summary, missing_citations(F.col("sources"), F.col("_cited"))).otherwise(missing_references(F.col("sources"), F.col("body")))
    leaks = F.regexp_count("body", F.lit(LEAKED_TYPE))
    open_keys = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(OPEN_FIELD), F.lit(1)), F.lower)))
    meta = F.filter(F.array(*map(F.lit, META_PHRASES)), lambda p: F.contains(F.lower("body"), p))
    stripped = F.length(F.regexp_replace("body", r"(?U)^\s+|\s+$", ""))
    again = repeated_block(F.col("_blocks"))
    checks = [
        _finding("sources", n > 0, F.lit("no sources")),
        F.when(n > 0, _finding("density", stripped / n >= LEAST_DENSITY, F.concat(F.floor(stripped / n).cast("string"), F.lit(" characters a source")))),
        _finding("citations", F.size(missing) == 0, _listed(missing)),
        _finding("leak", leaks == 0, F.concat(leaks.cast("string"), F.lit(" type lines"))),
        _finding("placeholder", F.size(open_keys) == 0, F.array_join(open_keys, ", ")),
        _finding("repeats", again.isNull(), F.substring(again, 1, 80)),
        _finding("meta", F.size(meta) == 0, F.array_join(meta, ", ")),
    ]
    found = rows.select("concept_id", "path", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("concept_id", "path", "f.*")
    return found if transcripts is None else found.unionByName(identifier_findings(rows.where(summary), transcripts))


def identifier_findings(aggregates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The findings of V8: one row for each aggregate with a source that has a transcript. aggregates: concept_id, path, sources, body."""
    known = aggregates.select("concept_id", "path", F.explode("sources").alias("rel_path")).join(transcripts.select("rel_path").distinct(), "rel_path", "left_semi").select("concept_id", "path").distinct()
    lost = lost_identifiers(aggregates.select(F.col("concept_id").alias("path"), "sources", "body"), transcripts)
    # The first eight of a sorted list, found in two steps: no list of all is made for one task.
    said = F.concat("label", F.lit("="), F.col("value"))
    first = lambda xs: F.slice(F.array_sort(xs), 1, MOST_EVIDENCE)
    parts = lost.groupBy("path", F.pmod(F.xxhash64("id_key"), F.lit(64)).alias("part")).agg(first(F.collect_list(said)).alias("some"), F.count("*").alias("n"))
    per = parts.groupBy(F.col("path").alias("concept_id")).agg(first(F.flatten(F.collect_list("some"))).alias("some"), F.sum("n").alias("n"))
    more = F.when(F.col("n") > MOST_EVIDENCE, F.concat(F.lit(" (+"), (F.col("n") - MOST_EVIDENCE).cast("string"), F.lit(" more)"))).otherwise("")
    evidence = F.coalesce(F.concat(F.lit("missing: "), F.array_join("some", ", "), more), F.lit(""))
    return known.join(per, "concept_id", "left").select("concept_id", "path", F.lit("identifiers").alias("check_id"), F.col("n").isNull().alias("passed"), evidence.alias("evidence"))


def report(found: DataFrame, key: str = "concept_id") -> DataFrame:
    """key, n_checks, n_failed, passed, banner."""
    line = F.concat(F.lit("_Verification: FLAGGED — "), F.col("check_id"), F.lit(": "), F.col("evidence"), F.lit("_"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), line)))  # at most one a check
    return found.groupBy(key).agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"), F.bool_and("passed").alias("passed"), F.array_join(failed, "\n\n").alias("banner"))


def with_banner(concepts: DataFrame, reports: DataFrame) -> DataFrame:
    """concepts with the failed checks written in front of the body (V9); the others as they are. reports: concept_id, passed, banner."""
    failed = reports.where("not passed").select("concept_id", "banner")
    body = F.when(F.col("banner").isNotNull(), F.concat("banner", F.lit("\n\n"), F.coalesce("body", F.lit("")))).otherwise(F.col("body"))
    return concepts.join(failed, "concept_id", "left").withColumn("body", body).drop("banner")


def lost_identifiers(aggregates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """path, id_key, label, value of the identifiers in the transcripts of an aggregate's sources that its body lacks.

    aggregates: path, sources, body; transcripts: rel_path, text. A source without a transcript is skipped.
    """
    sources = aggregates.select("path", F.explode("sources").alias("rel_path")).distinct()
    found = labelled_identifiers(transcripts.select("rel_path", "text"), "rel_path", "text")
    wanted = sources.join(found, "rel_path").groupBy("path", "id_key").agg(F.min_by(F.struct("label", "value"), "rel_path").alias("x"))
    bodies = aggregates.select("path", F.upper(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?U)[\s.]", "")).alias("bare"))
    return wanted.join(bodies, "path").where(~F.contains("bare", F.col("id_key"))).select("path", "id_key", "x.label", "x.value")
