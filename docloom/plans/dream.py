"""Synthesis across folders: digests, matters and the spliced report."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.gating import Gates, is_deprioritized, is_hidden
from docloom.functions.render import may_overwrite, navigation
from docloom.operators import digests, tokens, validation
from docloom.operators.extraction import localized
from docloom.operators.folders import navigation_stats
from docloom.plans.config import Config
from docloom.session import cut
from docloom.sources import sinks
from docloom.sources.okf import read_tree, render_document

#: text -> report
Model = Callable[[str], str]
BUDGET = 8000
RANGE_BATCHES = 64


def rule_synthesis(text: str) -> str:
    """Deterministic default: the aggregates that were read, as one matter each."""
    names = [line.removeprefix("### Aggregate: ") for line in text.split("\n") if line.startswith("### Aggregate: ")]
    return "## Matters\n\n" + "\n".join(f"- {n}" for n in names) + "\n\n## Patterns\n\n" + f"{len(names)} aggregates" if names else text


def rule_deep_dive(text: str) -> str:
    lines = [line for line in text.split("\n") if line.startswith("## ")]
    return "### Matter\n" + "; ".join(s[3:] for s in lines) + "\n### Conflicts\nnone\n### Actions\n"


@dataclass
class Dream:
    """matters: group_key, slug, n_members, source_hash, report, members (paths); synthesis: the report, or None if nothing changed (matters are then those that were known, or None)."""

    matters: DataFrame | None
    synthesis: str | None
    source_hash: str


def aggregates_of(concepts: DataFrame, gates: Gates = Gates()) -> DataFrame:  # noqa: B008
    """path and digest of the visible folder aggregates worth a synthesis (S18, F4 on the folder)."""
    kept = concepts.where((F.col("okf_type") == "FolderSummary") & ~is_hidden(F.col("path")) & ~is_deprioritized(F.col("folder"), gates))
    return kept.select("path", "body", digests.digest(*(F.col(c) for c in ("path", "title", "tags", "sources", "identifiers", "body"))).alias("digest"))


def deep_dives(members: DataFrame, known: DataFrame | None, model: Model, budget: int = BUDGET) -> DataFrame:
    """group_key, source_hash, report: one report a matter over the full texts of its members, in order of path and in batches; a matter whose members' hashes are known keeps its report.

    A matter is read by a model in one piece, so its members must fit a task; members that share
    an identifier do. members: group_key, path, body.
    """
    one, two = F.xxhash64("path", "body"), F.xxhash64("body", "path", F.lit(1))  # order-free: no list of the members is gathered
    hashed = members.groupBy("group_key").agg(F.concat_ws("-", F.count("*").cast("string"), F.hex(F.bit_xor(one)), F.hex(F.bit_xor(two))).alias("source_hash"))
    same = hashed.limit(0).withColumn("report", F.lit("")) if known is None else hashed.join(known.select("group_key", "source_hash", "report"), ["group_key", "source_hash"])
    work = members.join(hashed.join(same.select("group_key"), "group_key", "left_anti"), "group_key")

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path")
        texts = [f"# {p}\n\n{b or ''}" for p, b in zip(rows["path"], rows["body"], strict=True)]
        return pd.DataFrame({"group_key": rows["group_key"].iloc[:1], "source_hash": rows["source_hash"].iloc[:1], "report": [digests.fold(iter(texts), budget, model)]})

    kind = members.schema["group_key"].dataType.simpleString()
    fresh = work.select("group_key", "source_hash", "path", "body").groupBy("group_key").applyInPandas(go, f"group_key {kind}, source_hash string, report string")
    return fresh.unionByName(same.select("group_key", "source_hash", "report"))


def fold_tree(rows: DataFrame, order: str, text: str, model: Model, budget: int = BUDGET) -> str:
    """Map-reduce of a model over texts in order (L8): tasks fill batches greedily up to the budget and call the model on each; replies are batched again until one is left.

    A small tree is one partition, hence one greedy sequence: one call, or one a batch and one
    over the replies. A large one is cut into ranges of the order, each its own sequence. The
    driver sees the last reply only.
    """
    rows = rows.select(F.col(order).alias("k"), F.col(text).alias("t"))
    spark, limit = rows.sparkSession, budget
    while True:
        size = rows.agg(F.sum(F.length("t") + 2).alias("n"), F.max(F.length("t")).alias("most"), F.count("*").alias("rows")).first()
        if not size["rows"]:
            return ""
        # Batches of replies hold at least eight, so each level is at most an eighth of the one before.
        limit = budget if limit == budget else max(budget, 8 * (size["most"] + 2))
        parts = min(max(1, size["n"] // (RANGE_BATCHES * limit)), max(1, spark.sparkContext.defaultParallelism * 4))

        def go(blocks: Iterator[pd.DataFrame], limit: int = limit) -> Iterator[pd.DataFrame]:
            held: list[str] = []
            first, total = None, 0
            for block in blocks:
                for k, t in zip(block["k"], block["t"], strict=True):
                    if held and total + len(t) + 2 > limit:
                        yield pd.DataFrame({"k": [first], "t": [model("\n\n".join(held))]})
                        held, total = [], 0
                    first = k if not held else first
                    held.append(t)
                    total += len(t) + 2
            if held:
                yield pd.DataFrame({"k": [first], "t": [model("\n\n".join(held))]})

        kind = rows.schema["k"].dataType.simpleString()
        spread = (rows.repartitionByRange(parts, "k") if parts > 1 else rows.repartition(1)).sortWithinPartitions("k")
        rows = cut(spread.mapInPandas(go, f"k {kind}, t string"))
        if rows.count() == 1:
            return rows.first()["t"]
        limit = 0


def tree_hash(rows: DataFrame) -> str:
    """An order-free hash of paths and bodies: no list of all aggregates is gathered."""
    state = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "body")), F.lit(0)).alias("x"), F.coalesce(F.sum((F.xxhash64("path", "body", F.lit(1)) % 1000003)), F.lit(0)).alias("s")).first()
    return f"{state['n']}-{state['x'] & (2**64 - 1):016x}-{state['s']}"


def dream(concepts: DataFrame, gates: Gates = Gates(), principle: str = "provenance", known_hash: str | None = None, known_matters: DataFrame | None = None, synthesize: Model = rule_synthesis, dive: Model = rule_deep_dive, force: bool = False, budget: int = BUDGET) -> Dream:  # noqa: B008
    """One pass over the aggregates. The tree's hash comes first: an unchanged tree is neither grouped nor read by a model. Nothing is read in full but members of matters that changed.

    concepts holds one row a path (see newest_versions). Models are called by tasks; the
    driver gets the finished parts of the one report.
    """
    rows = cut(aggregates_of(concepts, gates))
    tree = tree_hash(rows)
    if tree == known_hash and not force:
        return Dream(known_matters, None, tree)
    found = tokens.token_rows(rows, "path", "digest", tokens.PRINCIPLE_DIGITS[principle])
    labels = tokens.components(tokens.token_edges(found, "path"))
    groups = tokens.matters(found, "path", tokens.token_rows(rows, "path", "digest"))
    members = cut(rows.join(labels.select(F.col("key").alias("path"), F.col("label").alias("group_key")), "path").select("group_key", "path", "body"))
    listed = members.groupBy("group_key").agg(F.array_sort(F.collect_list("path")).alias("members"))  # a matter's file lists them, so they fit it
    reports = cut(groups.join(deep_dives(members, None if force else known_matters, dive, budget), "group_key").join(listed, "group_key"))
    baseline = fold_tree(rows, "path", "digest", synthesize, budget)
    parts = {n: F.regexp_extract("report", rf"(?is)###\s*{n}\s*\n(.*?)(?=\n###|\z)", 1) for n in ("matter", "conflicts", "actions")}
    whole = F.when(F.col("report").rlike(r"(?i)(?:^|\n)###\s*(?:matter|conflicts|actions)"), parts["matter"]).otherwise(F.col("report"))
    texts = reports.select("group_key", F.trim(whole).alias("m"), F.trim(parts["conflicts"]).alias("c"), F.trim(parts["actions"]).alias("a")).orderBy("group_key").toLocalIterator()
    found_texts = [(r["m"], r["c"], r["a"]) for r in texts]  # the report holds them all, so they fit where it fits
    m, c, a = ([t[i] for t in found_texts] for i in range(3))
    one = rows.sparkSession.createDataFrame([(baseline, m, c, a)], "b string, m array<string>, c array<string>, a array<string>")
    return Dream(reports, one.select(digests.splice(F.col("b"), F.col("m"), F.col("c"), F.col("a"))).first()[0], tree)


def matter_documents(matters: DataFrame) -> DataFrame:
    """path, content of a file for each matter: links to its members, then its report, failed checks in front (K7, V9)."""
    link = lambda p: F.concat(F.lit("- ["), p, F.lit("](../"), p, F.lit(")"))
    body = F.concat(F.array_join(F.transform("members", link), "\n"), F.lit("\n\n"), F.coalesce("report", F.lit("")))
    path = F.concat(F.lit("matters/"), "slug", F.lit(".md"))
    made = matters.select(path.alias("concept_id"), path.alias("path"), F.lit("Matter").alias("okf_type"), F.col("slug").alias("title"), F.col("members").alias("sources"), body.alias("body"))
    done = validation.with_banner(made, validation.report(validation.findings(made)))
    return done.select("path", render_document({"type": F.col("okf_type"), "title": F.col("title"), "list:sources": F.col("sources")}, F.col("body")).alias("content"))


def run(spark: SparkSession, root: str, config: Config | None = None, force: bool = False, now: str = "", **models) -> tuple[Dream, dict[str, int]]:
    """Dream over the aggregates of a tree on a shared disk, against the state it keeps, and write matters, synthesis.md and the README (E2, K7-K9). Counts of what was written."""
    config = config or Config(document_root=root)
    kept = f"{root}/.docloom"
    concepts = cut(read_tree(spark, root).where(~F.col("path").startswith("matters/")))
    known, seen = sinks.load_state(spark, f"{kept}/matters"), sinks.load_state(spark, f"{kept}/tree")
    models = {name: (lambda text, own=own: own(localized(text, config.content_language))) if config.content_language else own for name, own in models.items()}
    done = dream(concepts, config.gates, config.ordering_principle, seen.first()["hash"] if seen is not None else None, known, force=force, **models)
    counts = {"matters": 0, "synthesis": 0, "deleted": 0}
    if done.synthesis is not None:
        counts["matters"] = sinks.write_texts(matter_documents(done.matters), root)
        if known is not None:
            gone = known.select("slug").join(done.matters.select("slug"), "slug", "left_anti")
            counts["deleted"] = sinks.delete_own(gone.select(F.concat(F.lit("matters/"), "slug", F.lit(".md")).alias("path")), root, ("Matter",))
        page = spark.createDataFrame([("synthesis.md", f"---\ntype: Synthesis\ntitle: Synthesis\n---\n\n{done.synthesis}")], "path string, content string")
        counts["synthesis"] = sinks.write_texts(page, root)
        sinks.save_state(done.matters, f"{kept}/matters")
        sinks.save_state(spark.createDataFrame([(done.source_hash,)], "hash string"), f"{kept}/tree")  # last: a run that fails before is run again
    counts["readme"] = write_readme(spark, root, concepts, done, now) if config.generate_readme else 0
    return done, counts


def write_readme(spark: SparkSession, root: str, concepts: DataFrame, done: Dream | None, now: str) -> int:
    """README.md of the tree, unless someone wrote one by hand (K9, F13). Top folders are listed; they are few, as a directory is."""
    target = os.path.join(root, "README.md")
    existing = None
    if os.path.exists(target):
        with open(target, encoding="utf-8") as f:
            existing = f.read()
    if not may_overwrite(existing):
        return 0
    stats = navigation_stats(concepts).first().asDict()
    stats["matters"] = done.matters.count() if done is not None and done.matters is not None else 0
    stats["has_synthesis"] = os.path.exists(os.path.join(root, "synthesis.md"))
    top = concepts.where(F.col("okf_type").isin("FolderSummary", "FolderIndex") & (F.col("folder") != "") & ~F.contains("folder", F.lit("/"))).select("folder", "description")
    text = navigation(os.path.basename(os.path.abspath(root)), stats, [(r["folder"], r["description"]) for r in top.collect()], now)
    return sinks.write_texts(spark.createDataFrame([("README.md", text)], "path string, content string"), root)


def exit_code(codes: list[int]) -> int:
    """The worst of several trees."""
    return max(codes, default=0)
