"""Problem 8: evaluation texts leaking into training texts, by latent semantic retrieval.

Documents are cut into overlapping passages of 24 words, one every 12: any run of 12 words
lies whole in one of them. Passages and items are TF-IDF vectors over hashed words, with
document frequencies counted over all documents. A randomised SVD of the passages of all
documents and items, its one product summed over partitions, gives latent directions.
Every passage is projected and compared with every item by cosine. Common runs
of 12 words are looked up exactly at every word of every document, whatever the cosine. For
paraphrases, every pair of passage and item that reaches the item's threshold, set so that all planted passages,
half that item and half any block of any document, pass, is checked by the longest common
subsequence and the item's rare words. Nothing is drawn from the documents: frequencies,
directions and thresholds are of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docloom.llm.charbatch import batches, flat, gram_hashes, word_bounds, word_hashes

RUN = 12
BUCKETS = 1 << 15
WORDS = 1 << 20
RANK = 48
OVERSAMPLE = 8
LENGTHS = 256
ITEM_BLOCK = 2_000
PARAPHRASE_SHARE = 0.7
ANSWER_SHARE = 0.6


class Passages:
    """Words of some texts, and their passages: blocks of RUN words, each with the one after it."""

    def __init__(self, texts: list[str], run: int = RUN):
        self.run = run
        codes, starts = flat([t.lower() for t in texts])
        start, end = word_bounds(codes)
        self.words = word_hashes(codes, start, end)
        self.bucket = (self.words & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.text_of = np.searchsorted(starts, start, side="right") - 1
        first = np.searchsorted(self.text_of, np.arange(len(texts)))
        self.count = np.bincount(self.text_of, minlength=len(texts))
        self.blocks = np.maximum(1, -(-self.count // run)) * (self.count > 0)
        total = int(self.blocks.sum())
        self.block_text = np.repeat(np.arange(len(texts)), self.blocks)
        inner = np.arange(total) - np.repeat(np.cumsum(self.blocks) - self.blocks, self.blocks)
        self.block_start = first[self.block_text] + inner * run
        self.last = inner == self.blocks[self.block_text] - 1
        self.text_end = (first + self.count)[self.block_text]

    def halves(self, weights: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projection, squared length) of each block: sums of weighted rows of `table` over its words."""
        rows = np.append(table * weights[:, None], np.zeros((1, table.shape[1]), np.float32), axis=0)
        at = self.block_start[:, None] + np.arange(self.run)[None, :]
        slots = np.append(self.bucket, BUCKETS)[np.minimum(at, len(self.bucket))]
        slots[at >= self.text_end[:, None]] = BUCKETS  # words that a text's last block has not weigh nothing
        sums = np.zeros((len(slots), table.shape[1]), np.float32)
        for a in range(0, len(slots), 2000):  # what is added stays in the cache
            for k in range(self.run):
                sums[a : a + 2000] += rows.take(slots[a : a + 2000, k], axis=0)
        return sums, np.append(weights * weights, np.float32(0))[slots].sum(axis=1)

    def vectors(self, weights: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projection, length) of each passage."""
        if not len(self.block_start):
            return np.zeros((0, table.shape[1]), np.float32), np.zeros(0, np.float32)
        sums, squares = self.halves(weights, table)
        following = np.where(self.last[:-1, None], np.float32(0), sums[1:])  # a copy: each block's own sum
        sums[:-1] += following
        squares[:-1] += np.where(self.last[:-1], np.float32(0), squares[1:])
        return sums, np.sqrt(squares)


@dataclass
class Model:
    """What a search needs: bounded by BUCKETS x RANK and the block of items."""

    weights: np.ndarray  # idf of each bucket
    table: np.ndarray  # BUCKETS x RANK: directions
    queries: np.ndarray  # RANK x items: unit projections
    thresholds: np.ndarray  # least cosine of each item's paraphrases
    ids: np.ndarray
    grams: np.ndarray  # sorted hashes of the items' runs
    gram_item: np.ndarray
    item_words: list[np.ndarray] = field(default_factory=list)
    item_rarity: list[np.ndarray] = field(default_factory=list)


def _per_batch(df: DataFrame, text: str, ddl: str, work) -> DataFrame:
    """work(list of texts) -> list of arrow arrays, once for each bounded batch of texts."""

    names = [c.strip().split(" ")[0] for c in ddl.split(",")]

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t for t in part.column(0).to_pylist() if t]
            for a, b in batches(texts):
                yield pa.RecordBatch.from_arrays(work(texts[a:b]), names=names)

    return df.select(text).mapInArrow(go, ddl)


def document_weights(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(inverse document frequency of each of BUCKETS, of each of WORDS, number of documents), in one pass: at most WORDS + 1 rows reach the driver.

    WORDS buckets are fine enough to tell rare words; a bucket of a vector counts for all
    words in it, each document once a word.
    """

    def work(texts: list[str]) -> list:
        p = Passages(texts)
        own = (p.words & np.uint64(WORDS - 1)).astype(np.int64)
        each = np.sort(p.text_of * WORDS + own)
        counts = np.bincount(each[np.diff(each, prepend=-1) != 0] % WORDS, minlength=WORDS)
        some = np.flatnonzero(counts)
        return [pa.array(np.append(some, WORDS), pa.int32()), pa.array(np.append(counts[some], len(texts)), pa.int64())]

    rows = _per_batch(df, text, "bucket int, n bigint", work).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(WORDS + 1)
    found[rows["bucket"]] = rows["n"]
    total, fine = int(found[WORDS]), found[:WORDS]
    coarse = np.minimum(fine.reshape(-1, BUCKETS).sum(axis=0), total)
    return *(np.log((1.0 + total) / (1.0 + n)).astype(np.float32) for n in (coarse, fine)), total


@dataclass
class Corpus:
    """What a search must know of the documents, whatever the items: made once for all blocks of items."""

    weights: np.ndarray
    rarity: np.ndarray
    documents: DataFrame
    start: np.ndarray  # BUCKETS x (RANK + OVERSAMPLE): random directions
    product: np.ndarray  # A'(A start) for the passage matrix A of all documents


def corpus_of(df: DataFrame, text: str, seed: int = 8) -> Corpus:
    """Two passes over the documents: frequencies, then the product."""
    weights, rarity, _ = document_weights(df, text)
    documents = df.where(F.length(text) > 0).select(text)
    start = np.random.default_rng(seed).standard_normal((BUCKETS, RANK + OVERSAMPLE)).astype(np.float32)
    return Corpus(weights, rarity, documents, start, _product(documents, text, weights, start))


def _rows(df: DataFrame, shared, shape: tuple[int, int], fill: float, add: Callable, join: Callable) -> np.ndarray:
    """One array of all texts: add(array, passages, shared value) for each batch of a task, whose changed rows are sent by number and joined one after the other, so that however many tasks there are a worker holds one array."""

    def changed(out: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero((out != fill).any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([r.tobytes() for r in out[some].astype(np.float32)], pa.binary())], names=["at", "row"])

    def go(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, value = np.full(shape, fill), shared.value
        for part in parts:
            texts = [x for x in part.column(0).to_pylist() if x]
            for a, b in batches(texts):
                add(out, Passages(texts[a:b]), value)
        yield changed(out)

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.full(shape, fill)
        for part in parts:
            for a in range(0, part.num_rows, 1000):
                some = part.slice(a, 1000)
                at = some.column(0).to_numpy()
                values = np.frombuffer(b"".join(some.column(1).to_pylist()), np.float32).reshape(len(at), -1).astype(np.float64)
                order = np.argsort(at, kind="stable")
                own, start = np.unique(at[order], return_index=True)
                out[own] = join(out[own], join.reduceat(values[order], start, axis=0))
        yield changed(out)

    ddl = "at int, row binary"
    rows = df.mapInArrow(go, ddl).repartition("at").mapInArrow(joined, ddl).toPandas()
    out = np.full(shape, fill, np.float32)
    if len(rows):
        out[rows["at"]] = np.stack([np.frombuffer(r, np.float32) for r in rows["row"]])
    shared.unpersist()
    return out


def _product(df: DataFrame, text: str, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A'(A table) for the passage matrix A of the texts, summed over partitions: BUCKETS x columns."""

    def add(out: np.ndarray, p: Passages, value: tuple) -> None:
        out += gram_product(p, *value)

    return _rows(df.select(text), df.sparkSession.sparkContext.broadcast((weights, table)), (BUCKETS, table.shape[1]), 0.0, add, np.add)


def gram_product(p: Passages, weights: np.ndarray, table: np.ndarray) -> np.ndarray:
    sums, _ = p.vectors(weights, table)
    out = np.zeros((table.shape[1], BUCKETS))
    if not len(sums):
        return out.T
    count = np.diff(np.append(p.block_start, len(p.words)))
    back = sums.copy()  # a word is in its block's passage and in that of the block before
    back[1:] += np.where(p.last[:-1, None], 0, sums[:-1])
    for k, column in enumerate(np.ascontiguousarray(back.T)):
        out[k] = np.bincount(p.bucket, np.repeat(column, count), minlength=BUCKETS)
    return out.T * weights[:, None]


def least_products(df: DataFrame, text: str, weights: np.ndarray, table: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least product with each item, squared length at most) of all blocks of the documents, for each of LENGTHS equal ranges of squared lengths; infinite where there is no block."""
    step = max(RUN * float(weights.max()) ** 2, 1e-9) / LENGTHS

    def add(out: np.ndarray, p: Passages, value: tuple) -> None:
        weights, table, queries = value
        if not len(p.block_start):
            return
        sums, squares = p.halves(weights, table)
        length = np.minimum((squares / step).astype(np.int64), LENGTHS - 1)
        order = np.argsort(length, kind="stable")
        products = sums[order] @ queries
        own, start = np.unique(length[order], return_index=True)
        for n, a, b in zip(own, start, np.append(start[1:], len(order)), strict=True):
            np.minimum(out[n], products[a:b].min(axis=0), out=out[n])

    shared = df.sparkSession.sparkContext.broadcast((weights, table, queries))
    return _rows(df.select(text), shared, (LENGTHS, queries.shape[1]), np.inf, add, np.minimum), step * np.arange(1, LENGTHS + 1)


def item_rarity(texts: list[str]) -> np.ndarray:
    """Inverse frequency of each of WORDS over items: items made from one pattern differ in their other words, which tell whether an item or a sister of it was paraphrased."""
    counts = np.zeros(WORDS)
    for a, b in batches(texts):
        p = Passages(texts[a:b])
        own = np.unique(p.text_of * WORDS + (p.words & np.uint64(WORDS - 1)).astype(np.int64)) % WORDS
        counts += np.bincount(own, minlength=WORDS)
    return np.log((1.0 + len(texts)) / (1.0 + counts)).astype(np.float32)


def directions(product: np.ndarray, start: np.ndarray) -> np.ndarray:
    """RANK leading directions of a positive matrix by its product with random ones (Nystrom's approximation: no second product); fewer, and zeros, if it has no more."""
    product, start = product.astype(np.float64), start.astype(np.float64)
    inner = start.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    some = values > 1e-6 * max(values.max(), 1e-30)
    root = product @ (turn[:, some] / np.sqrt(values[some]))
    out = np.zeros((len(product), RANK), np.float32)
    found = np.linalg.svd(root, full_matrices=False)[0][:, :RANK]
    out[:, : found.shape[1]] = found
    return out


def fit(corpus: Corpus, text: str, items: list[tuple[int, str]], among: np.ndarray | None = None) -> Model:
    """Directions by randomised SVD of the items and all documents, thresholds by planted passages. among: item_rarity of all items, if these are a block of them."""
    rarity = corpus.rarity + (item_rarity([t for _, t in items]) if among is None else among)
    weights, theirs = corpus.weights, corpus.product
    own = Passages([t for _, t in items])
    mine = gram_product(own, weights, corpus.start)
    # Items weigh as much as the corpus: they are what is searched.
    scale = np.linalg.norm(theirs) / max(np.linalg.norm(mine), 1e-9) if np.linalg.norm(theirs) > 0 else 1.0
    table = directions(theirs + scale * mine, corpus.start)
    lengths = np.bincount(own.text_of, minlength=len(items))
    first = np.cumsum(lengths) - lengths
    item_words = [own.words[a : a + c] for a, c in zip(first, lengths, strict=True)]
    whole = np.stack([(table[b] * weights[b][:, None]).sum(axis=0) if len(b) else np.zeros(RANK) for b in (own.bucket[a : a + c] for a, c in zip(first, lengths, strict=True))])
    queries = (whole / (np.linalg.norm(whole, axis=1, keepdims=True) + 1e-9)).T.astype(np.float32)
    grams, gram_item = [], []
    for i, words in enumerate(item_words):
        g = np.unique(gram_hashes(words, RUN))
        grams.append(g)
        gram_item.append(np.full(len(g), i))
    grams, gram_item = np.concatenate(grams), np.concatenate(gram_item)
    order = np.argsort(grams, kind="stable")
    thresholds = planted_thresholds([(w & np.uint64(BUCKETS - 1)).astype(np.int64) for w in item_words], *least_products(corpus.documents, text, weights, table, queries), weights, table, queries)
    return Model(weights, table, queries, thresholds, np.array([i for i, _ in items]), grams[order], gram_item[order], item_words, [rarity[(w & np.uint64(WORDS - 1)).astype(np.int64)] for w in item_words])


def _window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of each n neighbouring values."""
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return total[n:] - total[:-n]


def planted_thresholds(item_buckets: list[np.ndarray], products: np.ndarray, squares: np.ndarray, weights: np.ndarray, table: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each item a cosine that all passages of any RUN words of it (or all it has) and any block of any document reach, less a tenth.

    products, squares: least_products. With a product given, the cosine is least at an end of
    the range of lengths, so no block falls below.
    """
    out = np.full(len(item_buckets), -1.0, np.float32)
    some = np.flatnonzero(np.isfinite(products).all(axis=1))
    if not len(some):
        return out
    ends = np.concatenate([squares[some] - squares[0], squares[some]])
    for i, b in enumerate(item_buckets):
        if not len(b):
            continue
        other = np.tile(products[some, i], 2)
        own = _window_sums((table[b] @ queries[:, i]) * weights[b], min(RUN, len(b)))
        own_squares = _window_sums(weights[b] ** 2, min(RUN, len(b)))
        least = min(float(((own[at : at + 500, None] + other[None, :]) / (np.sqrt(np.maximum(own_squares[at : at + 500, None] + ends[None, :], 0)) + 1e-9)).min()) for at in range(0, len(own), 500))
        out[i] = least - 0.1 * abs(least)
    return out


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short word lists."""
    best = np.zeros(len(b) + 1, np.int64)
    for word in a:
        take = np.where(b == word, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], take))
    return int(best[-1])


def answer_share(rarity: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Share of the words (last axis) that are shared, each weighing what it is rarer than the middle one and a tenth of its rarity: ties of common words, however many, weigh little, and one odd word does not decide alone."""
    weight = np.maximum(rarity - np.median(rarity, axis=-1, keepdims=True), 0) + 0.1 * rarity
    return (weight * shared).sum(axis=-1) / np.maximum(weight.sum(axis=-1), 1e-6)


def answered(words: np.ndarray, rarity: np.ndarray, passage: np.ndarray, need: float) -> bool:
    """Whether the passage has the rare words of the item, or of a part of 2 * RUN words that it follows: a passage can't hold those of a whole long item."""
    shared = np.isin(words, passage)
    if answer_share(rarity, shared) >= ANSWER_SHARE:
        return True
    if len(words) <= 2 * RUN:
        return False
    starts = np.flatnonzero(_window_sums(shared, 2 * RUN) >= need)  # fewer shared words can't hold the subsequence
    for some in np.array_split(starts, -(-len(starts) // 1000)) if len(starts) else ():
        at = some[:, None] + np.arange(2 * RUN)[None, :]
        if any(longest_common(passage, words[a : a + 2 * RUN]) >= need for a in some[answer_share(rarity[at], shared[at]) >= ANSWER_SHARE]):
            return True
    return False


def search(texts: list[str], model: Model, paraphrases: bool = True) -> list[tuple[int, int, float, int, int, bool]]:
    """(text number, item number, cosine, words of the longest common run counted up from RUN or 0, common subsequence, answer) of candidates that pass a check."""
    p = Passages(texts)
    sums, lengths = p.vectors(model.weights, model.table)
    if not len(sums):
        return []
    cosines = (sums @ model.queries) / (lengths[:, None] + 1e-9)
    found: dict[tuple[int, int], list] = {}
    # Runs of RUN words at every word, whatever the cosine: a small table of marks, then the items' runs.
    hashes = gram_hashes(p.words, RUN)
    marks = np.zeros(1 << 20, np.bool_)
    marks[model.grams >> np.uint64(44)] = True
    at = np.flatnonzero(marks[hashes >> np.uint64(44)])
    at = at[p.text_of[at] == p.text_of[at + RUN - 1]]
    if len(at) and len(model.grams):
        hashes = hashes[at]
        lo, hi = np.searchsorted(model.grams, hashes, "left"), np.searchsorted(model.grams, hashes, "right")
        which = np.searchsorted(p.block_start, at, side="right") - 1
        # A run at the start of a block also lies in the passage before.
        before_too = (p.block_start[which] == at) & (which > 0) & (p.block_text[which - 1] == p.block_text[which])
        runs: dict[tuple[int, int], set] = {}
        for j in np.flatnonzero(hi > lo).tolist():
            for item in model.gram_item[lo[j] : hi[j]].tolist():
                pair = (int(p.block_text[which[j]]), item)
                runs.setdefault(pair, set()).add(int(at[j]))
                c = float(cosines[which[j] - int(before_too[j]) : which[j] + 1, item].max())
                entry = found.setdefault(pair, [c, 0, 0, True])
                entry[0] = max(entry[0], c)
        for pair, starts in runs.items():
            longest = now = 0
            before = -2
            for s in sorted(starts):
                now = now + 1 if s == before + 1 else 1
                longest, before = max(longest, now), s
            found[pair][1] = longest + RUN - 1
            found[pair][2] = longest + RUN - 1
    if paraphrases:
        over = cosines >= model.thresholds[None, :]
        vocabulary = np.unique(np.concatenate(model.item_words))
        known = np.minimum(np.searchsorted(vocabulary, p.words), max(len(vocabulary) - 1, 0))
        known = np.append(np.where(vocabulary[known] == p.words, known, len(vocabulary)), len(vocabulary)) if len(vocabulary) else np.zeros(len(p.words) + 1, np.int64)
        for item in np.flatnonzero(over.any(axis=0)).tolist():
            words = model.item_words[item]
            if not len(words):
                continue
            need = PARAPHRASE_SHARE * min(len(words), 2 * RUN)
            held = np.zeros(len(vocabulary) + 1, np.bool_)
            held[np.searchsorted(vocabulary, words)] = True
            near = np.flatnonzero(over[:, item])
            at = p.block_start[near][:, None] + np.arange(2 * RUN)[None, :]
            # No longer a common subsequence than the passage has words of the item.
            shared = (held[known[np.minimum(at, len(p.words))]] & (at < p.text_end[near][:, None])).sum(axis=1)
            for j in near[shared >= need].tolist():
                pair = (int(p.block_text[j]), item)
                if pair in found:
                    continue
                passage = p.words[p.block_start[j] : min(p.block_start[j] + 2 * RUN, p.text_end[j])]
                common = longest_common(passage, words)
                if common < need:
                    continue
                if answered(words, model.item_rarity[item], passage, need):
                    found[pair] = [float(cosines[j, item]), 0, common, True]
    return [(t, i, *v) for (t, i), v in found.items()]


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, paraphrases: bool = True) -> DataFrame:
    """key, item key, cosine, run_words, common_words for each document and item found in it.

    run_words is the length of the longest common run of words (0: a paraphrase, told by
    the longest common subsequence common_words and the item's rare words). All documents
    are searched, whole. Items are taken in blocks of ITEM_BLOCK, so what is sent to the
    workers stays bounded however many there are. Null and empty texts and items match
    nothing; repeated rows are repeated.
    """
    spark: SparkSession = df.sparkSession
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    ddl = f"k {kind}, item {item_kind}, cosine double, run_words int, common_words int"
    item_type = to_arrow_type(items.schema[item_key].dataType)
    # Held-out items are a stated query set: they go out in blocks, each a bounded table.
    rows = [(r[0], r[1]) for r in items.where(F.length(item_text) > 0).select(item_key, item_text).toLocalIterator()]
    out = spark.createDataFrame([], ddl)
    corpus, among = (corpus_of(df, text), item_rarity([t for _, t in rows])) if rows else (None, None)
    for at in range(0, len(rows), ITEM_BLOCK):
        shared = spark.sparkContext.broadcast(fit(corpus, text, rows[at : at + ITEM_BLOCK], among))

        def go(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for part in parts:
                texts = [t or "" for t in part.column(1).to_pylist()]
                for a, b in batches(texts):
                    hits = search(texts[a:b], model, paraphrases)
                    cols = list(zip(*hits, strict=True)) if hits else [()] * 6
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([a + t for t in cols[0]], pa.int64())), pa.array([model.ids[i].item() for i in cols[1]], item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())],
                        names=["k", "item", "cosine", "run_words", "common_words"],
                    )

        out = out.unionByName(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), text).mapInArrow(go, ddl))
    return out.select(F.col("k").alias(key), F.col("item").alias(item_key), "cosine", "run_words", "common_words")
