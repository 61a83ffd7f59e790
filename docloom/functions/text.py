"""Scalar functions on markdown, paths and verdicts, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and formats of the document format.
SOURCE_MARKER = r"(?md)^_Source: (.+)_$"
FLAG_MARKER = "_Verification: FLAGGED"
RESERVED_NAMES = ("index.md", "log.md")
OWN_TYPES = ("FolderSummary", "FolderIndex")
SUPPORTED_SUFFIXES = (".pdf", ".txt", ".docx", ".eml", ".csv", ".xlsx", ".png", ".jpg", ".jpeg")
NO_CONFLICT = ("no conflicts detected", "none", "keine konflikte")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """Folder of a relative path, '' for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def title_case(text: Column) -> Column:
    """Every run of letters with its first letter in upper and the rest in lower case (P4): unlike initcap, any other character begins a new word."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def default_title(title: Column, path: Column) -> Column:
    """The title, or one made of the file's stem."""
    return F.coalesce(F.nullif(title, F.lit("")), title_case(F.replace(stem(path), F.lit("_"), F.lit(" "))))


def folder_summary_path(folder: Column) -> Column:
    """<folder>/<name>.md (P5)."""
    return F.concat(folder, F.lit("/"), base_name(folder), F.lit(".md"))


def demote_headings(body: Column) -> Column:
    """Headings of level 1 to 5 one level down."""
    return F.regexp_replace(body, r"(?md)^(#{1,5}) ", "#$1 ")


def section(heading: Column, source: Column, issue: Column, body: Column) -> Column:
    """One section of a folder's aggregate."""
    flag = F.when(F.coalesce(issue, F.lit("")) != "", F.concat(F.lit("_Verification: FLAGGED — "), issue, F.lit("_\n\n"))).otherwise("")
    return F.concat(F.lit("## "), F.coalesce(F.nullif(heading, F.lit("")), source), F.lit("\n\n_Source: "), source, F.lit("_\n\n"), flag, demote_headings(body))


def cited_sources(body: Column) -> Column:
    """Names in the source markers of a body, in order."""
    return F.regexp_extract_all(body, F.lit(SOURCE_MARKER), F.lit(1))


def blocks(body: Column) -> Column:
    """Blocks between blank lines."""
    return F.split(body, r"\n\s*\n")


def normal_block(block: Column) -> Column:
    """White space collapsed and digits masked."""
    return F.regexp_replace(F.trim(F.regexp_replace(block, r"(?U)\s+", " ")), r"(?U)\d", "#")


def normal_identifier(value: Column) -> Column:
    """Without white space and dots."""
    return F.regexp_replace(value, r"(?U)[\s.]", "")


def verdict_passed(reply: Column) -> Column:
    """Whether a verifier's reply lets a text pass."""
    return ~F.upper(F.trim(reply)).startswith("FLAGGED")


def verdict_reason(reply: Column) -> Column:
    """The reason after FLAGGED, or '' (P21)."""
    return F.when(verdict_passed(reply), "").otherwise(F.regexp_replace(F.substring(F.trim(reply), 8, 1 << 30), r"^[: \-—]+", ""))


def pass_rate_class(rate: Column) -> Column:
    """pass from .8, neutral from .5, else fail; none for null."""
    return F.when(rate.isNull(), "none").when(rate >= 0.8, "pass").when(rate >= 0.5, "neutral").otherwise("fail")


def host_name(value: Column) -> Column:
    """Host of a URL or host:port (P25)."""
    return F.regexp_extract(value, r"^(?:[a-zA-Z][\w+.-]*://)?(?:[^@/]*@)?([^:/?#]*)", 1)


def is_local_host(value: Column) -> Column:
    """Loopback or a private IPv4 address."""
    host = host_name(value)
    return host.isin("localhost", "::1") | host.rlike(r"^(?:127|10)(?:\.\d{1,3}){3}$|^192\.168(?:\.\d{1,3}){2}$|^172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}$")


def is_conflict(text: Column) -> Column:
    """Whether a conflict block says that there is one."""
    return (F.coalesce(text, F.lit("")) != "") & ~F.lower(F.trim(text)).isin(*NO_CONFLICT)


def named_section(body: Column, name: str, others: tuple[str, ...], level: str = "##") -> Column:
    """Text of one of several sections with fixed headings, '' if it is missing."""
    found = F.regexp_extract(body, rf"(?s)(?:^|\n){level} {name}[ \t]*\n(.*?)(?=\n{level} (?:{'|'.join(others)})[ \t]*\n|\z)", 1)
    return F.regexp_replace(found, r"(?U)^\s+|\s+$", "")


def inline_html(text: Column) -> Column:
    """Escaped text with bold, links and emphasis as HTML."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    text = F.regexp_replace(text, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(text, r"(?U)(?<!\w)_(.+?)_(?!\w)", "<em>$1</em>")
