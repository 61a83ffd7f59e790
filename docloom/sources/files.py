"""Source files: walk, hashes and text of each format."""

from __future__ import annotations

import email
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.gating import Gates, is_hidden, is_supported, matches_any
from docloom.functions.text import base_name, parent
from docloom.session import cut

OLE_MAGIC = bytes.fromhex("D0CF11E0")
PDF_LOCK = re.compile(rb"/Encrypt\s*(?:\d+\s+\d+\s+R|<<)")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, folder, name of the files below a root, without those in hidden folders; files whose own name begins with a dot or an underscore count.

    Tasks list the folders of one level after the other, so the driver holds no names; links
    to folders are not followed. A missing root, or a folder that can't be read, has no files.
    """

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for folder in part["folder"]:
                try:
                    with os.scandir(os.path.join(root, folder)) as found:
                        rows = [(f"{folder}/{e.name}" if folder else e.name, e.is_dir(follow_symlinks=False), e.name) for e in found]
                except OSError:
                    continue
                rows = [(path, is_dir) for path, is_dir, name in rows if not (is_dir and name.startswith("."))]
                yield pd.DataFrame(rows, columns=["rel_path", "is_dir"])

    frontier, levels = spark.createDataFrame([("",)], "folder string"), []
    while True:
        level = cut(frontier.mapInPandas(go, "rel_path string, is_dir boolean"))
        levels.append(level.where("not is_dir").select("rel_path"))
        frontier = level.where("is_dir").select(F.col("rel_path").alias("folder"))
        if frontier.isEmpty():
            break
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism, "folder")
    rows = reduce(DataFrame.unionByName, levels)
    return rows.select("rel_path", parent(F.col("rel_path")).alias("folder"), base_name(F.col("rel_path")).alias("name"))


def gated(files: DataFrame, gates: Gates) -> tuple[DataFrame, DataFrame]:
    """(files to read, skipped with a reason): gates on paths come before anything is read (F3, A13). Files of other formats, the engine's own pages among them, and those in hidden folders are no documents and are not told as skipped."""
    p = F.col("rel_path")
    documents = files.where(is_supported(p) & ~is_hidden(parent(p)))
    excluded = matches_any(p, gates.exclude)
    return documents.where(~excluded), documents.where(excluded).select("rel_path", F.lit("excluded").alias("reason"))


def text_of_docx(content: bytes) -> str:
    """Paragraphs, then rows of tables with cells joined by a bar."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    lines = [s for p in body.findall(f"{w}p") if (s := said(p))]
    for row in (r for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr")):
        joined = " | ".join("\n".join(said(p) for p in c.findall(f"{w}p")) for c in row.findall(f"{w}tc"))
        if joined.strip():
            lines.append(joined)
    return "\n".join(lines)


def text_of_xlsx(content: bytes) -> str:
    """A line for each sheet's name, then its rows with cells joined by a bar."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    r = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{m}si")]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        lines = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
            lines.append(f"# Sheet: {sheet.get('name')}")
            target = targets[sheet.get(r)].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{m}row"):
                cells = []
                for c in row.findall(f"{m}c"):
                    value = c.find(f"{m}v")
                    if c.get("t") == "s" and value is not None:
                        cells.append(shared[int(value.text)])
                    elif c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{m}t")))
                    elif value is not None and value.text is not None:
                        cells.append(value.text)
                if "".join(cells).strip():
                    lines.append(" | ".join(cells))
    return "\n".join(lines)


def text_of_eml(content: bytes) -> str:
    """Four header lines, a blank line and the first plain part."""
    message = email.message_from_bytes(content)
    plain = next((p for p in message.walk() if p.get_content_type() == "text/plain"), None) if message.is_multipart() else message
    payload = plain.get_payload(decode=True) if plain is not None else b""
    body = payload.decode(plain.get_content_charset() or "utf-8", errors="ignore") if isinstance(payload, bytes) and plain is not None else ""
    return "\n".join(f"{h}: {message.get(h, '')}" for h in ("From", "To", "Subject", "Date")) + "\n\n" + body


def text_of_plain(content: bytes) -> str:
    """The text itself, invalid bytes left out; a table of values is not taken apart."""
    return content.decode("utf-8", errors="ignore")


Reader = Callable[[bytes], str]
READERS: dict[str, Reader] = {".docx": text_of_docx, ".xlsx": text_of_xlsx, ".eml": text_of_eml, ".csv": text_of_plain, ".txt": text_of_plain}


def pdf_reader() -> Reader | None:
    """Text layer of a PDF where pdfplumber is installed (S5); for OCR, conversion and vision see external.py."""
    try:
        import pdfplumber
    except ImportError:
        return None

    def read(content: bytes) -> str:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return "\n".join(t for page in pdf.pages if (t := page.extract_text()))

    return read


def read_texts(files: DataFrame, root: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """rel_path, folder, name, sha256, length, text, error: each file read once, by the task that owns it.

    A file that can't be read has an error and no text and never ends the run: encrypted,
    without a reader for its format, blank, or broken.
    """
    readers = {**READERS, **({".pdf": r} if (r := pdf_reader()) else {}), **(readers or {})}

    def one(rel: str) -> tuple[str | None, int | None, str | None, str | None]:
        import hashlib

        try:
            with open(os.path.join(root, rel), "rb") as f:
                content = f.read()
        except OSError as e:
            return None, None, None, f"unreadable: {e.strerror}"
        digest = hashlib.sha256(content).hexdigest()
        suffix = (re.search(r"\.[^.]*$", rel.lower()) or [""])[0]
        if suffix in (".docx", ".xlsx") and content.startswith(OLE_MAGIC) or suffix == ".pdf" and PDF_LOCK.search(content):
            return digest, len(content), None, "encrypted"
        if suffix not in readers:
            return digest, len(content), None, f"no reader for {suffix}"
        try:
            text = readers[suffix](content)
        except Exception as e:  # noqa: BLE001 - whatever a file does to its reader is the file's error
            return digest, len(content), None, f"broken: {type(e).__name__}"
        return digest, len(content), text if text.strip() else None, None if text.strip() else "empty"

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(r) for r in part["rel_path"]]
            yield part.assign(**{c: pd.Series([x[i] for x in rows], dtype=object if i != 1 else "Int64", index=part.index) for i, c in enumerate(("sha256", "length", "text", "error"))})

    kept = files.select("rel_path", "folder", "name")
    n = files.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(n, "rel_path").mapInPandas(go, "rel_path string, folder string, name string, sha256 string, length bigint, text string, error string")
