"""Problem 7: share of repeated content inside one document, by a short-circuit cascade.

A body is a case if at least `share` of its words lie in a run of `run` words that equals
a run starting earlier. Cheap rules each prove for many bodies that they can't be a case;
the exact measure runs on what is left. Cost and selectivity of every rule are estimated
on a sample, and the rules run in the order of bodies rejected per second. Every rejection
is a proof, so the order changes only the cost, never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.charbatch import TOP, batches, flat, gram_hashes, mix, word_bounds, word_hashes

RUN = 8
LEAST_WORDS = 16
SHARE = 0.35
SAMPLE_ROWS = 400


@lru_cache(maxsize=1)
def _digit_as_zero() -> np.ndarray:
    table = np.arange(TOP, dtype=np.uint32)
    table[np.fromiter((chr(i).isdigit() for i in range(TOP)), np.bool_, TOP)] = ord("0")
    return table


class Words:
    """Words of some texts; what several rules need is made once, when first asked for."""

    def __init__(self, texts: list[str]):
        codes, starts = flat([t.lower() for t in texts])
        self.codes = _digit_as_zero()[codes]
        self.start, self.end = word_bounds(self.codes)
        self.text_of = np.searchsorted(starts, self.start, side="right") - 1
        self.n = len(texts)
        self.count = np.bincount(self.text_of, minlength=self.n)
        self._hashes: np.ndarray | None = None

    def keep(self, alive: np.ndarray) -> None:
        """Go on with only the words of the texts in `alive`."""
        m = alive[self.text_of]
        self.start, self.end, self.text_of = self.start[m], self.end[m], self.text_of[m]
        if self._hashes is not None:
            self._hashes = self._hashes[m]

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = word_hashes(self.codes, self.start, self.end)
        return self._hashes

    def repeated(self, grams: np.ndarray, run: int) -> np.ndarray:
        """Words of each text within a run that equals an earlier run of the text, when equal grams are equal runs."""
        m = len(grams)
        if not m:
            return np.zeros(self.n, np.int64)
        inside = self.text_of[:m] == self.text_of[run - 1 : run - 1 + m]
        with np.errstate(over="ignore"):
            keys = grams ^ mix(self.text_of[:m].astype(np.uint64))
        at = np.flatnonzero(inside)
        order = np.argsort(keys[at], kind="stable")
        sorted_keys = keys[at][order]
        later = np.zeros(len(at), bool)
        later[order[1:]] = sorted_keys[1:] == sorted_keys[:-1]
        size = len(self.start) + 1
        change = np.bincount(at[later], minlength=size) - np.bincount(at[later] + run, minlength=size)
        return np.bincount(self.text_of[np.cumsum(change[:-1]) > 0], minlength=self.n)


def _too_few(w: Words, run: int, least: int, share: float) -> np.ndarray:
    return w.count < least


def _too_varied(w: Words, run: int, least: int, share: float) -> np.ndarray:
    """A repeated word has occurred before, so at most 1 - share of the words are different ones."""
    keys = w.hashes ^ mix(w.text_of.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount(w.text_of[order[first]], minlength=w.n)
    return w.count - distinct < share * w.count


def _lengths_differ(w: Words, run: int, least: int, share: float) -> np.ndarray:
    """Equal runs of words have equal runs of word lengths."""
    return w.repeated(gram_hashes((w.end - w.start).astype(np.uint64), run), run) < share * w.count


#: Each rule: texts that it proves to be no case.
RULES: dict[str, Callable[[Words, int, int, float], np.ndarray]] = {"too_few": _too_few, "too_varied": _too_varied, "lengths_differ": _lengths_differ}


def order_rules(texts: list[str], run: int = RUN, least: int = LEAST_WORDS, share: float = SHARE) -> list[str]:
    """Rules by texts rejected per second on the sample, each measured alone; rules that reject nothing are left out."""
    rates: dict[str, float] = {}
    for name, rule in RULES.items():
        w = Words(texts)
        began = time.perf_counter()
        rejected = int(rule(w, run, least, share).sum())
        rates[name] = rejected / max(time.perf_counter() - began, 1e-6)
    return sorted((r for r in rates if rates[r] > 0), key=lambda r: -rates[r])


def measure(texts: list[str], order: list[str] | None, run: int = RUN, least: int = LEAST_WORDS, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Words and repeated words of each text. With rules, texts that they reject get -1 repeated words."""
    words, again = [], []
    for a, b in batches(texts):
        w = Words(texts[a:b])
        alive = np.ones(w.n, bool)
        for name in order or []:
            alive &= ~RULES[name](w, run, least, share)
            w.keep(alive)
        n = w.repeated(gram_hashes(w.hashes, run), run)
        words.append(w.count)
        again.append(np.where(alive, n, -1))
    return (np.concatenate(words), np.concatenate(again)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _mapped(df: DataFrame, key: str, text: str, order: list[str] | None, run: int, least: int, share: float) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, again = measure(part.column(1).to_pylist(), order, run, least, share)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(again, pa.int64())], names=["k", "n_words", "repeated_words"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(go, f"k {kind}, n_words bigint, repeated_words bigint")
    return rows.withColumnRenamed("k", key)


def repetition_shares(df: DataFrame, key: str, text: str, run: int = RUN) -> DataFrame:
    """key, n_words, repeated_words, share for every row with a text; share is 0 for a text without words.

    Rows with a null text give no row; repeated rows repeat. Words are runs of letters and
    digits of the lower-cased text, with every digit read as 0.
    """
    rows = _mapped(df, key, text, None, run, 0, 0.0)
    return rows.withColumn("share", F.when(F.col("n_words") > 0, F.col("repeated_words") / F.col("n_words")).otherwise(F.lit(0.0)))


def repetitive(df: DataFrame, key: str, text: str, run: int = RUN, least: int = LEAST_WORDS, share: float = SHARE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """key, n_words, repeated_words of the rows that have at least `least` words and a share of repeated words of at least `share`.

    sample_rows bounds only the sample on which the order of the rules is estimated.
    """
    sample = [r[0] for r in df.where(F.col(text).isNotNull()).select(text).limit(sample_rows).collect()]
    rows = _mapped(df, key, text, order_rules(sample, run, least, share), run, least, share)
    return rows.where((F.col("n_words") >= least) & (F.col("repeated_words") >= share * F.col("n_words")))
