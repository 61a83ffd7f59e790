"""Digests of aggregates and their greedy batches (P12, W2), and the splice of matters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_conflict, named_section

SECTIONS = ("Matters", "Conflicts", "Patterns", "Open actions")


def digest(path: Column, title: Column, tags: Column, sources: Column, identifiers: Column, body: Column) -> Column:
    """The short text of an aggregate that a synthesis reads: no section bodies (P12). Empty parts are left out."""

    def labelled(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    ids = F.transform(F.array_sort(F.map_entries(identifiers)), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    at = F.instr(body, "## ")
    lines = F.filter(F.split(body, "\n"), lambda s: s.startswith("## ") | s.startswith("_Source: "))
    sections = F.when(F.size(lines) > 0, F.concat(F.lit("Sections:\n"), F.array_join(F.transform(lines, lambda s: F.concat(F.lit("  "), s)), "\n")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### Aggregate: "), path),
        labelled("Title: ", title),
        labelled("Tags: ", F.array_join(tags, ", ")),
        labelled("Sources: ", F.array_join(sources, ", ")),
        labelled("Identifiers: ", F.array_join(ids, "; ")),
        F.when(at > 1, labelled("Summary: ", F.trim(F.regexp_replace(F.substring(body, F.lit(1), at - 1), r"^\s+|\s+$", "")))),
        sections,
    )


def batch_numbers(lengths: list[int], budget: int) -> list[int]:
    """Batch of each item: an item opens a new one if it doesn't fit the budget, two characters a joint counted."""
    out, number, size = [], 1, 0
    for n in lengths:
        if size and size + n + 2 > budget:
            number, size = number + 1, 0
        size += n + 2
        out.append(number)
    return out


def batches(df: DataFrame, group: str, order: str, length: str, budget: int = 8000) -> DataFrame:
    """group, order, batch_no. A running sum that starts anew has no partial form: each group is one sequence. Groups are bundles' folders, so their rows (keys and lengths only) are bounded by one folder."""
    schema = df.select(group, order, length).schema

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return pd.DataFrame({group: rows[group], order: rows[order], "batch_no": batch_numbers(rows[length].tolist(), budget)})

    kinds = f"`{group}` {schema[group].dataType.simpleString()}, `{order}` {schema[order].dataType.simpleString()}, batch_no int"
    return df.select(group, order, length).groupBy(group).applyInPandas(go, kinds)


def splice(baseline: Column, matters: Column, conflicts: Column, actions: Column) -> Column:
    """A synthesis with its matters and conflicts replaced and actions added; unchanged if it has no known section or there are no matters.

    matters, conflicts, actions: arrays of texts; conflict texts that say there is none are left out.
    """
    part = {name: named_section(baseline, name, SECTIONS) for name in SECTIONS}
    known = baseline.rlike(rf"(?m)^## (?:{'|'.join(SECTIONS)})[ \t]*$")
    filled = lambda xs: F.array_join(F.filter(xs, lambda x: F.trim(x) != ""), "\n\n")
    new = {
        "Matters": F.coalesce(F.nullif(filled(matters), F.lit("")), part["Matters"]),
        "Conflicts": F.coalesce(F.nullif(filled(F.filter(conflicts, is_conflict)), F.lit("")), part["Conflicts"]),
        "Patterns": part["Patterns"],
        "Open actions": F.concat_ws("\n\n", F.nullif(part["Open actions"], F.lit("")), F.nullif(filled(actions), F.lit(""))),
    }
    joined = F.concat_ws("\n\n", *(F.when(new[n] != "", F.concat(F.lit(f"## {n}\n\n"), new[n])) for n in SECTIONS))
    return F.when(known & (F.size(matters) > 0), joined).otherwise(baseline)


def fold(texts: Iterator[str], budget: int, reply) -> str:
    """Map-reduce of a model over batches: one call for a single batch, else one each and one over the replies."""
    items = list(texts)
    numbers = batch_numbers([len(t) for t in items], budget)
    parts = ["\n\n".join(t for t, n in zip(items, numbers, strict=True) if n == k) for k in sorted(set(numbers))]
    replies = [reply(p) for p in parts]
    return replies[0] if len(replies) == 1 else reply("\n\n".join(replies)) if replies else ""
