"""Problem 3: personal information in free text, found by a linear-chain CRF and replaced by typed placeholders.

The field is trained from a small labelled table (personal_table.py): sentences with marked
slots, each filled in several notations. It decodes every line of every text by batched Viterbi. What it
marks is checked for the least that an item of its kind must have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.charbatch import batches
from docloom.llm.crf import TOKEN, TOKEN_OR_LINE, Field, train
from docloom.llm.personal_table import GIVEN, LABELS, texts

NAMES_MOST = 10_000


def labelled_sequences(given: list[str], seed: int = 5, fold: int | None = None) -> list[tuple[list[str], list[int]]]:
    """The labelled table as token sequences with label numbers."""
    out = []
    for text, marks in texts(given, seed, fold):
        found = list(TOKEN.finditer(text))
        out.append(([m.group() for m in found], [next((k for a, b, k in marks if a <= m.start() < b), 0) for m in found]))
    return [s for s in out if s[0]]


@lru_cache(maxsize=4)
def _fitted(given: tuple[str, ...]) -> Field:
    return train(labelled_sequences(list(given)), LABELS, frozenset({*given, *GIVEN}))


def fit(given: list[str]) -> Field:
    """The field for a list of given names; it depends on nothing else."""
    return _fitted(tuple(sorted(set(given))))


_AT = re.compile(r"\w ?@ ?[\w\-]+\.\w|[\[(]at[\])]| AT ")
_FIRST = re.compile(r"\+?[^\W_]")
_ORG = re.compile(r"(?:GmbH|AG|KG|Ltd|et fils|Bank|Bau)\b")


def _holds(kind: str, text: str) -> bool:
    """The least that an item of a kind must have."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return _AT.search(text) is not None
    if kind == "phone":
        return digits >= 7 and len(set(re.sub(r"\D", "", text))) > 1
    if kind == "idnum":
        return digits >= 5 and len(set(re.sub(r"\D", "", text))) > 1
    if kind == "address":
        return digits > 0 and any(c.isalpha() for c in text)
    return any(c.isupper() for c in text) and len(text) > 2 and not digits and not _ORG.search(text)


def items(texts: list[str], model: Field) -> Iterator[list[tuple[str, int, int]]]:
    """(kind, start, end) of the items of each text, 0-based; start is the first letter, digit or plus sign."""
    tokens: list[str] = []
    ends = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens += TOKEN_OR_LINE.findall(text)
        tokens.append("\n")
        ends[i] = len(tokens)
    # A sequence is a line, closed by its line end.
    line_end = np.flatnonzero(np.fromiter((t == "\n" for t in tokens), bool, len(tokens)))
    first = np.concatenate([[0], line_end[:-1] + 1]) if len(line_end) else np.zeros(0, np.int64)
    labels = model.decode(tokens, first)
    labels[line_end] = 0
    marked = np.flatnonzero(labels)
    # Runs of neighbouring tokens with one label; no run crosses a line end, which has none.
    cuts = np.flatnonzero((np.diff(marked) != 1) | (np.diff(labels[marked]) != 0)) + 1 if len(marked) else np.zeros(0, np.int64)
    from_, to = (np.concatenate([marked[:1], marked[cuts]]), np.concatenate([marked[cuts - 1], marked[-1:]])) if len(marked) else (marked, marked)
    line_of = np.searchsorted(line_end, from_)
    text_of = np.searchsorted(ends, from_, side="right")
    text_line = np.searchsorted(line_end, np.concatenate([[0], ends[:-1]]))  # first line of each text
    at = 0
    for i, text in enumerate(texts):
        out: list[tuple[str, int, int]] = []
        if at < len(from_) and text_of[at] == i:
            lines = text.split("\n")
            line, offset, spots = -1, 0, []
            while at < len(from_) and text_of[at] == i:
                this = int(line_of[at] - text_line[i])
                if this != line:
                    offset += sum(len(s) + 1 for s in lines[max(line, 0) : this])
                    line, spots = this, [m.span() for m in TOKEN.finditer(lines[this])]
                before = int(first[line_of[at]])
                a, b = offset + spots[from_[at] - before][0], offset + spots[to[at] - before][1]
                kind = LABELS[labels[from_[at]]]
                m = _FIRST.search(text, a, b)
                if m and _holds(kind, text[m.start() : b]):
                    out.append((kind, m.start(), b))
                at += 1
        yield out


def with_placeholders(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each item replaced by its kind in brackets; everything else unchanged.

    A bracket that opens just before an item and closes inside it belongs to the item.
    """
    out, at = [], 0
    for kind, a, b in found:
        if a > at and text[a - 1] in "([" and text[a:b].count(")]"["([".index(text[a - 1])]) > text[a:b].count(text[a - 1]):
            a -= 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _model(df: DataFrame, names: DataFrame | None, name_column: str) -> Field:
    given = [] if names is None else [r[0] for r in names.where(F.col(name_column).isNotNull()).select(name_column).limit(NAMES_MOST + 1).collect()]
    if len(given) > NAMES_MOST:
        raise ValueError(f"more than {NAMES_MOST} given names: use a shorter list")
    return fit(given)


def personal_items(df: DataFrame, key: str, text: str, identifiers: str, names: DataFrame | None = None, name_column: str = "given_name") -> DataFrame:
    """key, field, kind, map_key, start_at, end_at, item: one row per item.

    For the text, start_at and end_at are positions in characters, from 1, the end
    included; for the map of identifiers, start_at is the index in the list of map_key and
    end_at is null. Null texts, maps, lists and values hold nothing; repeated rows repeat.
    names is a list of given names that helps (more than NAMES_MOST are an error); none is needed.
    """
    model = df.sparkSession.sparkContext.broadcast(_model(df, names, name_column))  # bounded by the labelled table
    kind = df.schema[key].dataType.simpleString()
    schema = f"k {kind}, field string, kind string, map_key string, start_at bigint, end_at bigint, item string"
    columns = ["k", "field", "kind", "map_key", "start_at", "end_at", "item"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def of_texts(texts: list[str | None], field: Field) -> Iterator[tuple]:
        whole = [t or "" for t in texts]
        for a, b in batches(whole, 400_000):
            for i, found in enumerate(items(whole[a:b], field), a):
                for what, s, e in found:
                    yield i, "body", what, "", s + 1, e, whole[i][s:e]

    def of_maps(maps: list, field: Field) -> Iterator[tuple]:
        rows = [(i, k, n, v) for i, m in enumerate(maps) for k, vs in (m or []) for n, v in enumerate(vs or [], 1) if v]
        lines = [f"{k}: {v}".replace("\n", " ") for _, k, _, v in rows]
        for (i, k, n, v), found in zip(rows, items(lines, field), strict=True):
            inside = [(what, s, e) for what, s, e in found if e > len(k) + 2]
            if inside:
                what = max(inside, key=lambda x: x[2] - x[1])[0]
                yield i, "identifiers", what, k, n, None, v

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [*of_texts(part.column(1).to_pylist(), model.value), *of_maps(part.column(2).to_pylist(), model.value)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], names=columns)

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(identifiers).alias("m")).mapInArrow(go, schema)
    return rows.withColumnRenamed("k", key)


def without_personal_items(df: DataFrame, key: str, text: str, identifiers: str, names: DataFrame | None = None, name_column: str = "given_name") -> DataFrame:
    """key, text and identifiers (as array of key and values) of every row, items replaced by placeholders like [EMAIL]."""
    model = df.sparkSession.sparkContext.broadcast(_model(df, names, name_column))
    kind = df.schema[key].dataType.simpleString()
    values = "array<struct<key: string, values: array<string>>>"

    def one(maps: list, field: Field) -> list:
        flat = [f"{k}: {v or ''}".replace("\n", " ") for m in maps for k, vs in (m or []) for v in (vs or [])]
        found = iter(items(flat, field))
        out = []
        for m in maps:
            if m is None:
                out.append(None)
                continue
            row = []
            for k, vs in m:
                new = []
                for v in vs or []:
                    inside = [x for x in next(found) if x[2] > len(k) + 2]
                    new.append(v if not v or not inside else f"[{max(inside, key=lambda x: x[2] - x[1])[0].upper()}]")
                row.append({"key": k, "values": None if vs is None else new})
            out.append(row)
        return out

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).to_pylist()
            clean: list[str | None] = []
            for a, b in batches([t or "" for t in texts], 400_000):
                clean += [None if t is None else with_placeholders(t, f) for t, f in zip(texts[a:b], items([t or "" for t in texts[a:b]], model.value), strict=True)]
            maps = pa.array(one(part.column(2).to_pylist(), model.value), pa.list_(pa.struct([("key", pa.string()), ("values", pa.list_(pa.string()))])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string()), maps], names=["k", "t", "m"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(identifiers).alias("m")).mapInArrow(go, f"k {kind}, t string, m {values}")
    return rows.select(F.col("k").alias(key), F.col("t").alias(text), F.map_from_entries("m").alias(identifiers))
