"""Gates on paths: what is hidden, excluded, trivial or reserved."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import RESERVED_NAMES, SUPPORTED_SUFFIXES, base_name

# Words in a path that mark boilerplate, by language.
TRIVIAL_WORDS = (
    # German
    "agb", "bedienungsanleitung", "gebrauchsanweisung", "handbuch", "widerruf", "widerrufsbelehrung", "datenschutzerklaerung", "datenschutzerklärung", "nutzungsbedingungen", "werbung", "prospekt", "katalog",
    # English
    "manual", "userguide", "user-guide", "terms", "termsofservice", "tos", "privacy", "privacypolicy", "withdrawal", "cancellationpolicy", "advertisement", "advertising", "catalog", "catalogue", "brochure", "newsletter", "flyer",
    # French
    "manueldutilisation", "modedemploi", "conditionsgenerales", "conditionsgénérales", "cgu", "cgv", "politiquedeconfidentialite", "politiquedeconfidentialité", "retractation", "rétractation", "publicite", "publicité", "prospectus", "infolettre",
    # Spanish
    "manualdeusuario", "terminosycondiciones", "términosycondiciones", "condicionesdeuso", "politicadeprivacidad", "políticadeprivacidad", "derechodedesistimiento", "publicidad", "catalogo", "catálogo", "folleto", "boletin", "boletín",
    # Italian
    "manualedistruzioni", "terminicondizioni", "condizionidiutilizzo", "informativaprivacy", "dirittodirecesso", "recesso", "pubblicita", "pubblicità", "opuscolo", "volantino",
    # Dutch
    "handleiding", "gebruiksaanwijzing", "algemenevoorwaarden", "privacybeleid", "herroepingsrecht", "reclame", "catalogus", "nieuwsbrief",
)


@dataclass(frozen=True)
class Gates:
    """Glob patterns of a bundle; a match is on the whole path or the bare name."""

    exclude: tuple[str, ...] = ()
    low_priority: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()


def glob_regex(pattern: str) -> str:
    """A glob as a Java regex: * crosses /, ? is one character, [..] a class, [!..] its complement."""
    out, i = "", 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 if pattern[i : i + 1] not in ("!",) else i + 2)) > 0:
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})\\z"


def matches_any(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path or its name matches one of the globs (F2)."""
    result = F.lit(False)
    for p in patterns:
        result = result | path.rlike(glob_regex(p)) | base_name(path).rlike(glob_regex(p))
    return result


def is_hidden(path: Column) -> Column:
    """Some part of the path begins with a dot (F1)."""
    return path.rlike(r"(?:^|/)\.")


def is_reserved(path: Column) -> Column:
    return base_name(path).isin(*RESERVED_NAMES)


def is_supported(path: Column) -> Column:
    """Suffix of a format that can be read."""
    return F.regexp_extract(F.lower(base_name(path)), r"\.[^.]*$", 0).isin(*SUPPORTED_SUFFIXES)


def is_deprioritized(path: Column, gates: Gates = Gates()) -> Column:  # noqa: B008
    """Priority patterns win, then low-priority patterns, then trivial words anywhere in the path."""
    trivial = F.lower(path).rlike("|".join(re.escape(w) for w in TRIVIAL_WORDS))
    return F.when(matches_any(path, gates.priority), False).when(matches_any(path, gates.low_priority), True).otherwise(trivial)
