"""Concept documents as text: front matter and body."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import cut

FIELDS = "type string, title string, description string, tags array<string>, timestamp string, source string, sources array<string>, source_hashes map<string,string>, identifiers map<string,array<string>>, resource string, okf_version string, extra string, body string"


def _scalar(text: str):
    text = text.strip()
    if text in ("", "null", "~"):
        return None
    if text[0] == text[-1] and text[0] in "'\"" and len(text) > 1:
        inner = text[1:-1]
        return inner.replace("''", "'") if text[0] == "'" else inner.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
    if text in ("[]", "{}"):
        return [] if text == "[]" else {}
    if text[0] in "[{" or ": " in text or text[0] in "&*!|>%@`":
        if text[0] == "[" and text[-1] == "]" and not any(c in text[1:-1] for c in "[]{}:"):
            return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
        raise ValueError(f"not a plain scalar: {text}")
    return text


def parse_yaml(raw: str) -> dict:
    """The YAML that front matter uses: scalars, lists and up to two levels of maps, by indentation. Raises ValueError on anything else."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        try:
            data = yaml.safe_load(raw)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
        if data is None:
            return {}
        if not isinstance(data, dict):
            raise ValueError("front matter is no map")
        return data
    lines = [(len(s) - len(s.lstrip()), s.strip()) for s in raw.split("\n") if s.strip() and not s.strip().startswith("#")]

    def block(at: int, indent: int):
        if at < len(lines) and lines[at][1].startswith("- ") or at < len(lines) and lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("-"):
                out.append(_scalar(lines[at][1][1:]))
                at += 1
            return out, at
        made: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            key, colon, rest = lines[at][1].partition(":")
            if not colon or (rest and not rest.startswith(" ")):
                raise ValueError(f"no key: {lines[at][1]}")
            at += 1
            if rest.strip():
                made[_scalar(key)] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
                made[_scalar(key)], at = block(at, lines[at][0])
            else:
                made[_scalar(key)] = None
        return made, at

    if not lines:
        return {}
    made, at = block(0, lines[0][0])
    if at < len(lines) or not isinstance(made, dict):
        raise ValueError("unexpected indentation")
    return made


def parse_document(content: str) -> dict:
    """Fields of a concept document; anything malformed is an Unknown whose body is the whole content."""
    import json

    unknown = {"type": "Unknown", "body": content}
    parts = content.split("---", 2) if content.startswith("---") else []
    if len(parts) < 3:
        return unknown
    known = {f.split(" ")[0] for f in FIELDS.split(", ")} - {"extra", "body"}
    try:
        data = parse_yaml(parts[1].strip())
        if not isinstance(data.get("type"), str) or not data["type"]:
            raise ValueError("no type")
        out = {k: v for k, v in data.items() if k in known and v is not None}
        for k in ("tags", "sources"):
            out[k] = [str(x) for x in out.get(k) or []]
        out["source_hashes"] = {str(k): str(v) for k, v in (out.get("source_hashes") or {}).items()}
        out["identifiers"] = {str(k): [str(x) for x in v] for k, v in (out.get("identifiers") or {}).items()}
        for k in known - {"tags", "sources", "source_hashes", "identifiers"}:
            if k in out:
                out[k] = str(out[k])
        rest = {k: v for k, v in data.items() if k not in known}
        out["extra"] = json.dumps(rest, ensure_ascii=False, default=str) if rest else None
    except (ValueError, AttributeError, TypeError):
        return unknown
    return {**out, "body": parts[2].strip()}


def parse_documents(df: DataFrame, key: str, content: str) -> DataFrame:
    """key and the fields of each document. A null content is an Unknown with a null body."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [parse_document(c) if c is not None else {"type": "Unknown"} for c in part["c"]]
            yield pd.DataFrame({"k": part["k"], **{n: pd.Series([r.get(n) for r in rows], dtype=object, index=part.index) for n in names}})

    return df.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(go, f"k {kind}, {FIELDS}").withColumnRenamed("k", key)


def _quoted(value: Column) -> Column:
    """A YAML scalar in single quotes: always valid, whatever it holds but line ends, which become blanks."""
    return F.concat(F.lit("'"), F.replace(F.regexp_replace(value, r"\s*\n\s*", " "), F.lit("'"), F.lit("''")), F.lit("'"))


def render_document(fields: dict[str, Column], body: Column) -> Column:
    """Front matter and body as text, JVM side (P2). fields: name to a string, array<string>, map<string,string> or map<string,array<string>> column with the kind as prefix: 'list:tags', 'map:source_hashes', 'lists:identifiers'."""
    lines = []
    for name, value in fields.items():
        kind, _, bare = name.rpartition(":")
        items = lambda xs, pad="": F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f"{pad}- "), _quoted(x), F.lit("\n"))), "")
        if kind == "list":
            line = F.when(F.size(value) > 0, F.concat(F.lit(f"{bare}:\n"), items(value))).otherwise(F.lit(f"{bare}: []\n"))
        elif kind in ("map", "lists"):
            entries = F.array_sort(F.map_entries(value))
            one = (lambda e: F.concat(F.lit("  "), _quoted(e["key"]), F.lit(": "), _quoted(e["value"]), F.lit("\n"))) if kind == "map" else (lambda e: F.concat(F.lit("  "), _quoted(e["key"]), F.lit(":\n"), items(e["value"], "  ")))
            line = F.when(F.size(entries) > 0, F.concat(F.lit(f"{bare}:\n"), F.array_join(F.transform(entries, one), ""))).otherwise(F.lit(f"{bare}: {{}}\n"))
        else:
            line = F.concat(F.lit(f"{bare}: "), _quoted(value), F.lit("\n"))
        lines.append(F.coalesce(F.when(value.isNotNull(), line), F.lit("")))
    return F.concat(F.lit("---\n"), *lines, F.lit("---\n\n"), F.coalesce(body, F.lit("")))


def with_link(body: Column, title: Column, target: Column, context: Column) -> Column:
    """The body with a link under Related; the same link is added once."""
    line = F.trim(F.concat(F.lit("- ["), F.coalesce(F.nullif(title, F.lit("")), F.lit("Related")), F.lit("]("), target, F.lit(") "), F.coalesce(context, F.lit(""))))
    headed = F.when(F.contains(body, F.lit("## Related")), body).otherwise(F.concat(body, F.lit("\n\n## Related\n")))
    return F.when(F.contains(body, line), headed).otherwise(F.concat(headed, F.lit("\n"), line))


def read_contents(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path, folder, content of every visible file with a suffix below a root, read by tasks; a null content could not be read."""
    from docloom.sources.files import list_files

    paths = list_files(spark, root).where(F.col("name").endswith(suffix) & ~F.col("name").startswith("."))

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            contents = []
            for p in part["rel_path"]:
                try:
                    with open(os.path.join(root, p), encoding="utf-8", errors="replace") as f:
                        contents.append(f.read())
                except OSError:
                    contents.append(None)
            yield pd.DataFrame({"path": part["rel_path"], "folder": part["folder"], "content": pd.Series(contents, dtype=object, index=part.index)})

    spread = paths.select("rel_path", "folder").repartition(spark.sparkContext.defaultParallelism, "rel_path")
    return cut(spread.mapInPandas(go, "path string, folder string, content string"))


def read_tree(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path, folder and the fields of every visible concept document below a root."""
    texts = read_contents(spark, root, suffix)
    return parse_documents(texts, "path", "content").join(texts.select("path", "folder"), "path").withColumnRenamed("type", "okf_type")


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, text of the transcripts that an ingest left below a root: each lies at the path of its source, with .txt after it."""
    texts = read_contents(spark, os.path.join(root, ".docloom", "transcripts"), ".txt")
    return texts.select(F.regexp_replace("path", r"\.txt$", "").alias("rel_path"), F.col("content").alias("text"))
