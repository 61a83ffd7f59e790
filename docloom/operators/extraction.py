"""Deriving facts from texts through pluggable extractors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import verdict_passed, verdict_reason
from docloom.operators.chunking import chunks
from docloom.sources.okf import FIELDS, parse_document

#: text, context -> a concept document as text; text, document -> OK or FLAGGED: reason
Extractor = Callable[[str, str], str]
Verifier = Callable[[str, str], str]

_LABELLED = re.compile(r"^[ \t]*[-*]?[ \t]*([^\W\d_][\w .°-]{2,30}?)[ \t]*:[ \t]*(\S*\d\S*(?: \S*\d\S*){0,3})[ \t]*$", re.M)


def rule_extractor(text: str, context: str) -> str:
    """Deterministic default: a Fact titled by the first line, labelled numbers as identifiers and key data, and the first paragraph."""
    first = next((s.strip("# \t") for s in text.split("\n") if s.strip()), context)[:80]
    found: dict[str, list[str]] = {}
    for label, value in _LABELLED.findall(text):
        found.setdefault(label.strip().lower(), []).append(value)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ids = "".join(f"  {quote(k)}:\n" + "".join(f"  - {quote(v)}\n" for v in sorted(set(vs))) for k, vs in sorted(found.items()))
    data = "".join(f"- {k}: {v}\n" for k, vs in sorted(found.items()) for v in sorted(set(vs)))
    paragraph = next((p.strip() for p in re.split(r"\n\s*\n", text) if len(p.strip()) > 40), text.strip())
    return f"---\ntype: Fact\ntitle: {quote(first)}\n" + (f"identifiers:\n{ids}" if ids else "") + "---\n\n" + (f"**Kerndaten**\n{data}\n" if data else "") + paragraph


def rule_verifier(text: str, document: str) -> str:
    """Deterministic default: every long number of the document stands in the text."""
    bare = re.sub(r"[\s.]", "", text)
    missing = sorted({t for t in re.findall(r"\d{5,}", document) if t not in bare})
    return f"FLAGGED: {', '.join(missing[:3])} not in the source" if missing else "OK"


def derive(texts: DataFrame, key: str, text: str, extractor: Extractor = rule_extractor, threshold: int = 8000, overlap: int = 500) -> DataFrame:
    """key, chunk_no, error and the document fields derived from each chunk (L1). A failing call is a row with an error, so one bad text never ends or repeats a run."""
    kind = texts.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, i, n, chunk in part[["k", "chunk_no", "n_chunks", "chunk"]].itertuples(index=False):
                context = f"{k} (part {i}/{n})" if n > 1 else str(k)
                try:
                    rows.append({**parse_document(extractor(chunk, context)), "error": None})
                except Exception as e:  # noqa: BLE001 - the extractor is the caller's
                    rows.append({"error": f"{type(e).__name__}: {e}"[:500]})
            out = {"k": part["k"], "chunk_no": part["chunk_no"], "error": pd.Series([r["error"] for r in rows], dtype=object, index=part.index)}
            yield pd.DataFrame({**out, **{n: pd.Series([r.get(n) for r in rows], dtype=object, index=part.index) for n in names}})

    cut = chunks(texts, key, text, threshold, overlap).withColumnRenamed(key, "k")
    return cut.mapInPandas(go, f"k {kind}, chunk_no int, error string, {FIELDS}").withColumnRenamed("k", key)


def verify(documents: DataFrame, key: str, text: str, body: str, verifier: Verifier = rule_verifier) -> DataFrame:
    """key, passed, reason of each derived document against its source text."""
    kind = documents.schema[key].dataType.simpleString()

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"k": part["k"], "reply": [verifier(t or "", b or "") for t, b in zip(part["t"], part["b"], strict=True)]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(body).alias("b")).mapInPandas(go, f"k {kind}, reply string")
    return rows.select(F.col("k").alias(key), verdict_passed(F.col("reply")).alias("passed"), verdict_reason(F.col("reply")).alias("reason"))


def localized(prompt: str, language: str) -> str:
    """A prompt with the demand to answer in a language; unchanged without one. Verdicts are never localised: they are parsed."""
    return f"{prompt}\n\nWrite your answer in this language: {language}." if language else prompt


# Media types of images by suffix.
IMAGE_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}


def image_payload(content: Column, name: Column) -> Column:
    """A data URL of an image for a model that sees (P28, P29); an unknown suffix counts as PNG."""
    types = F.create_map(*(F.lit(x) for pair in IMAGE_TYPES.items() for x in pair))
    kind = F.coalesce(F.try_element_at(types, F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))), F.lit("image/png"))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def replies(rows: DataFrame, key: str, text: str, model: Callable[[str], str]) -> DataFrame:
    """key, reply of a model to each text, called by tasks (L2, L6: give it image_payload as text)."""
    kind = rows.schema[key].dataType.simpleString()

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"k": part["k"], "reply": [model(t or "") for t in part["t"]]})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(go, f"k {kind}, reply string").withColumnRenamed("k", key)


def preflight(models: dict[str, Callable[[], list[str]]]) -> None:
    """Each model must be among those that its client offers; a client used in two roles is asked once.

    models: name of the model to a function that lists what its client offers.
    """
    asked: dict[int, list[str]] = {}
    missing = []
    for name, offered in models.items():
        if id(offered) not in asked:
            asked[id(offered)] = offered()
        if name not in asked[id(offered)]:
            missing.append(name)
    if missing:
        raise LookupError(f"models not offered: {', '.join(missing)}")


@dataclass(frozen=True)
class ExtractionOptions:
    """How much work a text gets."""

    verify: bool = True
    orientation: bool = True
    ocr: bool = True


DEFAULT = ExtractionOptions()
LIGHT = ExtractionOptions(verify=False, orientation=False, ocr=False)
