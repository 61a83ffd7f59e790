"""Problem 10: long exact spans that several documents share.

Fixed-block anchors: the non-overlapping blocks of one text are indexed, every rolling
window of the other is probed against them, and hits are extended to maximal exact
repeats. Probing every window of a corpus at once would shuffle some 16 bytes for each of
its characters, so texts are first paired: of every 151 consecutive windows of 150
characters the one with the smallest hash is kept (winnowing, Schleimer et al. 2003). A
common span of 300 characters holds 151 common windows, hence a common smallest one: no
span of at least 300 characters is missed, and 1.3 % of the windows is shuffled. Windows of
half a span keep shorter boilerplate from pairing texts that share nothing longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.charbatch import batches, char_hashes, code_points, flat, mix
from docloom.session import cut

LEAST = 300
BASE = 0x9E3779B97F4A7C15 | 1


def block_length(least: int) -> int:
    """Length of windows and blocks: half of `least`, the most at which a span surely holds a whole aligned block."""
    return max(1, least // 2)


def rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of `length` code points."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        # Polynomial hash by prefix sums: H[i] = sum of c_j * BASE^-j before i; a window is (H[i+n] - H[i]) * BASE^i.
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        n = len(codes)
        up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(char_hashes()[codes] * down, out=prefix[1:], dtype=np.uint64)
        return mix((prefix[length:] - prefix[:-length]) * up[: n - length + 1])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Positions whose values include the smallest of every `width` consecutive values (of equal ones, one is enough): block-wise prefix and suffix minima."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= width:
        return np.array([int(values.argmin())])
    pad = -n % width
    padded = np.concatenate([values, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[: n - width + 1], left[width - 1 : n])
    # A value is chosen if it equals the minimum of a window that covers it.
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    is_low = np.zeros(n, bool)
    for s in starts.tolist():
        is_low[s + int(values[s : s + width].argmin())] = True
    return np.flatnonzero(is_low)


def fingerprints(texts: list[str], least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, different chosen window hashes) of the texts with at least `least` characters."""
    length = block_length(least)
    width = least - length + 1
    for a, b in batches(texts):
        codes, starts = flat(texts[a:b])
        hashes = rolling(codes, length)
        for i in range(b - a):
            size = int(starts[i + 1] - starts[i]) - 1
            if size >= least:
                own = hashes[starts[i] : starts[i] + size - length + 1]
                yield a + i, np.unique(own[smallest(own, width)])


def common_spans(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the maximal common spans of at least `least` characters, 0-based.

    Index the non-overlapping blocks of a, probe every window of b, extend to both sides.
    Of hits on one diagonal only the first within a span is extended.
    """
    length = block_length(least)
    x, y = code_points(a), code_points(b)
    if min(len(x), len(y)) < least:
        return []
    at = np.arange(0, len(x) - length + 1, length)
    blocks = rolling(x, length)[at]
    order = np.argsort(blocks, kind="stable")
    index, at = blocks[order], at[order]
    probes = rolling(y, length)
    lo, hi = np.searchsorted(index, probes, "left"), np.searchsorted(index, probes, "right")
    hit = np.flatnonzero(hi > lo)
    out, done = [], {}
    for j in hit.tolist():
        for i in at[lo[j] : hi[j]].tolist():
            if done.get(j - i, -1) >= j:
                continue
            n = min(len(x) - i, len(y) - j)
            differ = np.flatnonzero(x[i : i + n] != y[j : j + n])
            right = int(differ[0]) if len(differ) else n
            if right < length:
                continue  # equal hashes of different windows
            m = min(i, j)
            differ = np.flatnonzero(x[i - m : i][::-1] != y[j - m : j][::-1])
            left = int(differ[0]) if len(differ) else m
            done[j - i] = j + right - 1
            if left + right >= least:
                out.append((i - left, j - left, left + right))
    return sorted(set(out))


def representatives(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """key, rep for each row with a text of at least `least` characters; rep is the smallest key of its exact copies. Only digests are shuffled."""
    rows = df.where(F.length(text) >= least).select(F.col(key).alias("key"), F.unhex(F.md5(text)).alias("digest"))
    reps = rows.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
    return rows.join(reps, "digest", "left").select("key", F.coalesce("rep", "key").alias("rep"))


def candidate_pairs(texts: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """Different pairs a < b of representatives with a common chosen window. The pairs of a window go out in rows of one text each, so no group is gathered in memory."""
    kind = texts.schema["key"].dataType.simpleString()

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, hashes = [], []
            for i, own in fingerprints(part.column(1).to_pylist(), least):
                keys.append(np.full(len(own), i))
                hashes.append(own)
            take = pa.array(np.concatenate(keys) if keys else [], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64())], names=["key", "hash"])

    copies = members.where("key <> rep").select("key")
    marks = cut(texts.select("key", "text").mapInArrow(go, f"key {kind}, hash bigint").join(copies, "key", "left_anti"))
    shared = marks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    live = marks.join(shared, "hash")
    return live.select("hash", F.col("key").alias("a")).join(live.select("hash", F.col("key").alias("b")), "hash").where("a < b").select("a", "b").distinct()


def span_pairs(texts: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """a, b, start_a, start_b, length (positions from 1): maximal common spans of different texts a < b."""
    kind = texts.schema["key"].dataType.simpleString()
    pairs = cut(candidate_pairs(texts, members, least))
    involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    live = texts.join(involved, "key", "left_semi")  # only texts of some pair go on
    joined = pairs.join(live.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(live.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(a, b, i + 1, j + 1, n) for a, b, x, y in part[["a", "b", "ta", "tb"]].itertuples(index=False) for i, j, n in common_spans(x, y, least)]
            yield pd.DataFrame(rows, columns=["a", "b", "start_a", "start_b", "length"])

    return joined.mapInPandas(go, f"a {kind}, b {kind}, start_a int, start_b int, length int")


def shared_spans(df: DataFrame, key: str, text: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members: key, rep) and (spans between representatives: a, b, start_a, start_b, length).

    Texts shorter than `least` and null texts are in neither. Exact copies share one
    representative, the smallest key; keys must be unique. Both come from checkpoints.
    """
    texts = df.where(F.length(text) >= least).select(F.col(key).alias("key"), F.col(text).alias("text"))
    members = cut(representatives(df, key, text, least))
    return members, cut(span_pairs(texts, members, least))


def document_pairs(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Every pair doc_id_a < doc_id_b of documents with a common span, exact copies included."""
    crowd = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    copies = members.join(crowd, "rep", "left_semi")
    within = copies.select("rep", F.col("key").alias("x")).join(copies.select("rep", F.col("key").alias("y")), "rep").where("x < y").select("x", "y")
    between = spans.select("a", "b").distinct().join(members.select(F.col("rep").alias("a"), F.col("key").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("key").alias("y")), "b")
    every = within.unionByName(between.select("x", "y"))
    return every.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def window_classes(df: DataFrame, key: str, text: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members: key, rep) and (key, start, n_texts, class_id, first_key of every window of `least` characters that stands in more than one different text).

    No pairs are made: a window's class is its hash, with the number of its texts and their
    smallest key; n texts with one common passage give n rows a window, not n squared. A window
    holds a chosen shorter window wherever it stands, so only windows around chosen ones that
    several texts have are hashed. class_id is one number for each set of texts. Ends of
    common passages are exact, which extending each text against one representative would
    not give: two texts may have more in common with each other than with that one.
    """
    kind = df.schema[key].dataType.simpleString()
    length = block_length(least)
    width = least - length + 1
    texts = df.where(F.length(text) >= least).select(F.col(key).alias("key"), F.col(text).alias("text"))
    members = cut(representatives(df, key, text, least))

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            whole = part.column(1).to_pylist()
            rows, hashes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in batches(whole):
                codes, starts = flat(whole[a:b])
                all_ = rolling(codes, length)
                for i in range(b - a):
                    own = all_[starts[i] : starts[i + 1] - length]
                    at = smallest(own, width)
                    rows.append(np.full(len(at), a + i))
                    hashes.append(own[at])
                    places.append(at)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places), pa.int32())], names=["key", "hash", "at"])

    def hash_around(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, (t, at) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                own = rolling(code_points(t), least)
                edge = np.zeros(len(own) + 1, np.int64)
                at = np.array(at, np.int64)
                np.add.at(edge, np.clip(at - (width - 1), 0, len(own)), 1)
                np.add.at(edge, np.clip(at + 1, 0, len(own)), -1)
                around = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                rows.append(np.full(len(around), i))
                starts.append(around)
                hashes.append(own[around])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(hashes).view(np.int64))], names=["key", "start", "hash"])

    copies = members.where("key <> rep").select("key")
    marks = cut(texts.mapInArrow(choose, f"key {kind}, hash bigint, at int").join(copies, "key", "left_anti"))
    shared = marks.groupBy("hash").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("hash")
    anchors = marks.join(shared, "hash").groupBy("key").agg(F.collect_list("at").alias("ats"))  # places in one text
    windows = cut(texts.join(anchors, "key").select("key", "text", "ats").mapInArrow(hash_around, f"key {kind}, start int, hash bigint"))
    # Distinct first: partial, and no group of a hot window is gathered.
    own = windows.select("hash", "key").distinct()
    classes = own.groupBy("hash").agg(F.count("*").alias("n_texts"), F.bit_xor(F.xxhash64("key")).alias("class_id"), F.min("key").alias("first_key")).where("n_texts > 1")
    return members, cut(windows.join(classes, "hash").select("key", "start", "n_texts", "class_id", "first_key"))


def shared_stretches(windows: DataFrame, least: int = LEAST) -> DataFrame:
    """key, start_at, length, n_texts, first_key, class_id: the maximal stretches of a text whose windows all stand in the same set of texts, positions from 1.

    Every common passage of two texts is a run of such stretches; the texts of a stretch are
    those with its class_id.
    """
    order = Window.partitionBy("key", "class_id").orderBy("start")  # the windows of one text
    runs = windows.withColumn("run", F.col("start") - F.row_number().over(order)).groupBy("key", "class_id", "n_texts", "first_key", "run").agg(F.min("start").alias("s"), F.max("start").alias("e"))
    return runs.select("key", (F.col("s") + 1).alias("start_at"), (F.col("e") - F.col("s") + least).alias("length"), "n_texts", "first_key", "class_id")


def shared_shares(df: DataFrame, key: str, text: str, members: DataFrame, windows: DataFrame, least: int = LEAST) -> DataFrame:
    """key, n_chars, shared_chars, share, n_copies, n_texts for each row with a text: characters in windows found elsewhere (exact copies are shared whole), other exact copies, and the most different texts that have one window of it."""
    order = Window.partitionBy("key").orderBy("start")  # the windows of one text
    step = F.least(F.lit(least), F.coalesce(F.col("start") - F.lag("start").over(order), F.lit(least)))
    covered = windows.withColumn("step", step).groupBy(F.col("key").alias("rep")).agg(F.sum("step").cast("int").alias("covered"), F.max("n_texts").alias("n_texts"))
    crowd = members.groupBy("rep").agg((F.count("*") - 1).alias("copies"))
    known = members.join(crowd, "rep").join(covered, "rep", "left").select(F.col("key").alias(key), "copies", "covered", "n_texts")
    rows = df.where(F.col(text).isNotNull()).select(key, F.length(text).alias("n_chars")).join(known, key, "left")
    shared = F.when(F.coalesce("copies", F.lit(0)) > 0, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0))
    return rows.select(key, "n_chars", shared.alias("shared_chars"), share.alias("share"), F.coalesce("copies", F.lit(0)).alias("n_copies"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))
