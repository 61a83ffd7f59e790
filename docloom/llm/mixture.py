"""Problem 9: mixing sources to target weights by raking and calibrated sampling.

Sizes are tokens of a public tokenizer. Each document belongs to a cell (source, language,
topic). Iterative proportional fitting rakes the cells' token weights to the marginals of
source (the targets), language and topic (given shares, or those of the whole corpus, the
sources without a target included); a document's expected number of copies is the weight
of its cell, never more than its source allows. Copies are then drawn by these
probabilities from a hash of the key, so that a rerun, or a retry after a lost executor,
draws the same documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.language import NAMES
from docloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The usual pre-tokenisation of byte-level BPE vocabularies of this kind: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOPICS_MOST = 1_000
OTHER = "(other)"
STEPS = 500
TOLERANCE = 1e-6
BINS = 4096

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, loaded once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = PATTERN
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, key: str, text: str, others: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """key, others and n_tokens of each row; a null text has 0 tokens."""
    fields = df.select(key, *others).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens bigint"

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part in parts:
            texts = part.column(part.num_columns - 1).to_pylist()
            n = pa.array([len(own.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], names=[f.name for f in fields] + ["n_tokens"])

    return df.select(key, *others, F.col(text).alias("_text")).mapInArrow(go, ddl)


def source_name(source: Column) -> Column:
    """Sources that differ only in case or outer blanks are one."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def language_name(label: Column) -> Column:
    names = F.create_map(*(F.lit(x) for code, all_ in NAMES.items() for n in all_ for x in (n, code)))
    return F.coalesce(F.try_element_at(names, F.split(F.lower(F.trim(label)), "[-_ ]")[0]), F.lit("?"))


def rake(cells: pd.DataFrame, targets: dict[str, float], most: dict[str, float], goals: dict[str, dict[str, float]], total: float | None = None, steps: int = STEPS) -> tuple[np.ndarray, dict[str, float]]:
    """(weight of each cell, tokens wanted of each source).

    cells: source, lang, topic, tokens (all positive). goals: shares wanted of each lang and
    topic; values that no cell has are left out, values without a share get none. Without a
    total, it is the largest at which every source that has documents can give its share
    (shares of sources without any are spread over the others in proportion); with one, a
    source whose cap binds gives what it can. Source comes last in each step: its marginal
    holds, and language and topic come as near as sources and caps allow. A weight never
    exceeds its source's `most`; what that cuts off is spread over the source's other cells.
    """
    have = cells.groupby("source")["tokens"].sum()
    live = {s: t for s, t in targets.items() if have.get(s, 0) > 0 and t > 0}
    if not live:
        return np.zeros(len(cells)), {}
    scale = sum(live.values())
    limit = {s: most[s] * have[s] for s in live}
    if total is None:
        total = min(limit[s] / (t / scale) for s, t in live.items())
    wanted = {s: min(total * t / scale, limit[s]) for s, t in live.items()}
    tokens = cells["tokens"].to_numpy(float)
    of = {c: pd.factorize(cells[c]) for c in ("source", "lang", "topic")}
    goal_source = np.array([wanted.get(s, 0.0) for s in of["source"][1]])
    cap = np.array([float(most.get(s, 0)) for s in cells["source"]])
    own = np.bincount(of["source"][0], tokens, len(of["source"][1]))
    weight = (goal_source / own)[of["source"][0]]
    marginals = []
    for column in ("lang", "topic"):
        shares = np.array([goals[column].get(v, 0.0) for v in of[column][1]])
        if shares.sum() > 0:
            marginals.append((of[column][0], shares / shares.sum() * goal_source.sum()))
    for _ in range(steps):
        before = weight
        for code, goal in (*marginals, (of["source"][0], goal_source)):
            sums = np.bincount(code, weight * tokens, len(goal))
            weight = weight * np.divide(goal, sums, out=np.zeros_like(goal), where=sums > 0)[code]
        for _ in range(20):  # the caps, kept within each source
            weight = np.minimum(weight, cap)
            sums = np.bincount(of["source"][0], weight * tokens, len(goal_source))
            free = np.bincount(of["source"][0], np.where(weight < cap, weight * tokens, 0), len(goal_source))
            lack = goal_source - sums
            if (lack <= TOLERANCE * np.maximum(goal_source, 1)).all():
                break
            weight = np.where(weight < cap, weight * (1 + np.divide(lack, free, out=np.zeros_like(lack), where=free > 0))[of["source"][0]], weight)
        weight = np.minimum(weight, cap)
        if np.abs(weight - before).max() <= TOLERANCE * max(1.0, weight.max()):
            break
    return weight, wanted


def mixture(
    df: DataFrame, key: str, text: str, source: str, lang: str, topic: Column, targets: DataFrame,
    lang_shares: dict[str, float] | None = None, topic_shares: dict[str, float] | None = None, total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 9,
) -> DataFrame:
    """key, source, lang, topic, n_tokens, weight, copies for every document; weight and copies are 0 for a null source or one without a target.

    targets: source, target_share, max_repeats. Copies of a document are its weight rounded
    up or down, by a hash of its key, and never more than max_repeats. lang_shares and
    topic_shares are the marginals wanted, those of all documents if not given. Topics after
    the TOPICS_MOST largest are one, OTHER, so the table of cells (sources with a target,
    languages, topics) that reaches the driver is bounded whatever the corpus holds. Keys
    should be unique, or equal keys share their fate. Null and empty texts have 0 tokens.
    """
    spark: SparkSession = df.sparkSession
    goal = {r["s"]: (r["t"], r["m"]) for r in targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").alias("t"), F.col("max_repeats").alias("m")).where("s is not null and t > 0 and m > 0").collect()}  # one row a source, as the targets are given
    sized = df.select(F.col(key).alias("k"), source_name(F.col(source)).alias("source"), language_name(F.col(lang)).alias("lang"), F.coalesce(topic, F.lit("?")).alias("topic"), F.col(text).alias("t"))
    sized = cut(token_counts(sized, "k", "t", ["source", "lang", "topic"], tokenizer))
    largest = sized.groupBy("topic").agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), "topic").limit(TOPICS_MOST).select("topic", F.lit(True).alias("kept"))
    sized = sized.join(F.broadcast(largest), "topic", "left").withColumn("topic", F.when(F.col("kept"), F.col("topic")).otherwise(OTHER)).drop("kept")  # at most TOPICS_MOST rows
    aimed = F.col("source").isin(*goal) if goal else F.lit(False)
    cells = sized.groupBy(F.when(aimed, F.col("source")).alias("source"), "lang", "topic").agg(F.sum("n_tokens").cast("double").alias("tokens")).where("tokens > 0").toPandas()
    shares = {c: (given if given is not None else (cells.groupby(c)["tokens"].sum() / max(cells["tokens"].sum(), 1)).to_dict()) for c, given in (("lang", lang_shares), ("topic", topic_shares))}
    table = cells[cells["source"].notna()].sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    weight, wanted = rake(table, {s: t for s, (t, _) in goal.items()}, {s: float(m) for s, (_, m) in goal.items()}, shares, total)
    table = table[["source", "lang", "topic"]].assign(weight=weight, most=[goal[s][1] for s in table["source"]])
    known = spark.createDataFrame(table, "source string, lang string, topic string, weight double, most int")
    part = F.col("weight") - F.floor("weight")
    uniform = (F.pmod(F.xxhash64("k", F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    drawn = sized.join(F.broadcast(known), ["source", "lang", "topic"], "left")  # bounded: targets x languages x TOPICS_MOST
    drawn = drawn.withColumn("whole", F.least(F.floor("weight"), F.col("most").cast("long"))).withColumn("turn", F.when(part > 1e-9, uniform / part))
    # Tokens by source and turn, in bins: where the source has enough, it stops.
    turn = F.least(F.floor(F.col("turn") * (BINS // 4)), F.lit(BINS - 1))
    bins = drawn.where(aimed).groupBy("source", turn.alias("bin")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.coalesce("whole", F.lit(0))).alias("sure")).toPandas()
    stops = spark.createDataFrame(_stops(bins, wanted), "source string, stop int")
    copies = F.col("whole") + F.coalesce((turn < F.col("stop")) & (F.col("whole") < F.col("most")), F.lit(False)).cast("long")
    rows = drawn.join(F.broadcast(stops), "source", "left")  # one row a source
    return rows.select(F.col("k").alias(key), "source", "lang", "topic", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce(copies, F.lit(0)).alias("copies"))


def mixture_marginals(mixed: DataFrame) -> DataFrame:
    """dimension (lang or topic), value, corpus_share, weighted_share, actual_share: what raking aimed at (if no shares were given), what the weights reach and what was drawn."""
    cubes = mixed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("lang", "topic")))).alias("d"), "n_tokens", "weight", "copies")
    per = cubes.groupBy("d.dimension", "d.value").agg(F.sum("n_tokens").alias("a"), F.sum(F.col("n_tokens") * F.col("weight")).alias("b"), F.sum(F.col("n_tokens") * F.col("copies")).alias("c"))
    whole = Window.partitionBy("dimension")  # at most TOPICS_MOST rows
    share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c) / F.sum(c).over(whole)).otherwise(0.0)
    return per.select("dimension", "value", share("a").alias("corpus_share"), share("b").alias("weighted_share"), share("c").alias("actual_share"))


def _stops(bins: pd.DataFrame, wanted: dict[str, float]) -> list[tuple[str, int]]:
    """For each source the bin before which drawing ends: the one that comes nearest to the tokens it wants."""
    out = []
    for s, goal in wanted.items():
        own = bins[bins["source"] == s]
        rest = goal - own["sure"].sum()
        drawn = own[own["bin"].notna()].sort_values("bin")
        sums = np.concatenate([[0], drawn["tokens"].cumsum()])
        ends = np.concatenate([[0], drawn["bin"].to_numpy() + 1])
        out.append((s, int(ends[np.abs(sums - rest).argmin()])))
    return out


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_documents, n_tokens, mixed_tokens, actual_share, most_copies for every target."""
    per = mixed.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    per = cut(per)
    total = per.agg(F.sum("mixed_tokens").alias("total"))  # one row
    goals = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    rows = goals.join(per, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    share = F.when(F.col("total") > 0, F.coalesce("mixed_tokens", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    return rows.select("source", "target_share", "max_repeats", zero("n_documents"), zero("n_tokens"), zero("mixed_tokens"), share.alias("actual_share"), zero("most_copies"))
