"""Problem 1: splitting oversized texts at natural boundaries.

One regular expression of bounded quantifiers walks over the text: its alternatives are
ordered by the strength of the boundary they end at, each takes as much as the limit
allows, and the last takes plain characters. The overlap is looked up behind each piece
by its offset. Everything is a Catalyst expression: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 8000
OVERLAP = 500


def core_pattern(size: int) -> str:
    """Pattern whose successive matches tile a text with cores of at most size characters.

    Alternatives: the rest, if it fits; up to a blank line, a line end or white space in
    the last three quarters; the same three anywhere; characters.
    """
    least = max(1, size // 4)
    ends = (r"(?<=\n[ \t\r]{0,8}\n)", r"(?<=\n)", r"(?<=\s)")
    late = [f".{{{least},{size}}}{e}" for e in ends]
    early = [f".{{1,{least}}}{e}" for e in ends]
    return f"(?s)(?:.{{1,{size}}}\\z|" + "|".join(late + early) + f"|.{{1,{size}}})"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start_at, core_at, text>> of a text, or null for a null text.

    start_at and core_at are 1-based positions in characters of the piece and of its part
    that no earlier piece has; text from start_at begins with up to `overlap` characters of
    the end of the piece before. A text within the limit is one piece, an empty one none.
    Joining text[core_at - start_at:] of all pieces gives the text back.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    cores = F.regexp_extract_all(text, F.lit(core_pattern(limit - overlap)), F.lit(0))
    # One fold over the cores: where the last ended, the end of the piece before, and the pieces so far.
    # Each piece is made from its own core and that end, so the text is never counted through again.
    kind = "array<struct<start_at: int, core_at: int, text: string>>"
    long = F.aggregate(
        cores,
        F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"), F.array().cast(kind).alias("out")),
        lambda acc, core: F.struct(
            (acc["end"] + F.length(core)).alias("end"),
            F.right(F.concat(acc["tail"], core), F.lit(overlap)).alias("tail"),
            F.concat(acc["out"], F.array(F.struct((acc["end"] - F.length(acc["tail"]) + 1).alias("start_at"), (acc["end"] + 1).alias("core_at"), F.concat(acc["tail"], core).alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    one = F.array(F.struct(F.lit(1).alias("start_at"), F.lit(1).alias("core_at"), text.alias("text")))
    none = F.filter(one, lambda _: F.lit(False))
    return F.when(F.length(text) > limit, long).when(F.length(text) > 0, one).when(text.isNotNull(), none)


def split_documents(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: key, piece_no (from 1), n_pieces, start_at, core_at, piece.

    Null and empty texts give no row; repeated rows give repeated pieces; other columns of
    df are never read, so their names can't clash. start_at, core_at: see pieces().
    """
    cut = df.select(F.col(key).alias(key), pieces(F.col(text), limit, overlap).alias("_p"))
    return cut.select(key, F.size("_p").alias("n_pieces"), F.posexplode("_p").alias("_i", "_x")).select(
        key,
        (F.col("_i") + 1).alias("piece_no"),
        "n_pieces",
        F.col("_x.start_at").alias("start_at"),
        F.col("_x.core_at").alias("core_at"),
        F.col("_x.text").alias("piece"),
    )
