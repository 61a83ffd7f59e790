"""A linear-chain conditional random field in numpy: training to the optimum by L-BFGS, decoding by batched Viterbi."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(r"[^\W_][\w.+\-]*@[\w\-]+(?:\.[\w\-]+)+|\+?[^\W_]+(?:[._+\-/][^\W_]+)*|[^\w\s]|_")
TOKEN_OR_LINE = re.compile(TOKEN.pattern + r"|\n")
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
# Two more places that speak about a token with digits: the last word before it, however far, and the word before that.
LAST = (len(OFFSETS), len(OFFSETS) + 1)
SHAPE_REACH = 2
SUFFIX_REACH = 1


def shape(token: str) -> str:
    """Word shape: X, x and d for runs of letters and digits (the length of digit runs told, z for a first one that begins with 0), other characters as they are."""
    if "@" in token and len(token) > 1:
        return "x@x"
    out = []
    for m in re.finditer(r"\d+|[^\W\d_]+|.", token):
        t = m.group()
        if t[0].isdigit():
            out.append(f"{'z' if t[0] == '0' and not out else 'd'}{min(len(t), 15)}")
        elif t[0].isalpha():
            out.append(("X" if t.isupper() else "Xx" if t[0].isupper() else "x") + (str(len(t)) if len(t) < 4 else ""))
        else:
            out.append(t)
    return "".join(out[:12])


def features(token: str, listed: frozenset[str]) -> tuple[str, str, str]:
    """Word (none if it has digits), shape and suffix of a token."""
    return "" if any(c.isdigit() for c in token) else token.lower(), shape(token), ("listed" if token.capitalize() in listed else token[-4:].lower() if token[0].isalpha() else "")


def sort(token: str) -> int:
    """1: a word, 2: a token with digits, 0: anything else."""
    return 2 if any(c.isdigit() for c in token) else 1 if token[0].isalpha() else 0


def last_words(sorts: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the last word before a token with digits and for the word before that: the tokens that have it in their sequence, and its place."""
    words = np.flatnonzero(sorts == 1)
    at = np.flatnonzero(sorts == 2)
    begin = first[np.searchsorted(first, at, "right") - 1] if len(at) else at
    out = []
    for back in (1, 2):
        nth = np.searchsorted(words, at) - back
        place = np.where(nth >= 0, words[np.maximum(nth, 0)] if len(words) else -1, -1)
        inside = place >= begin
        out.append((at[inside], place[inside]))
    return out


@dataclass
class Field:
    """Weights: emission tables by feature, one row a value, places (OFFSETS, then LAST) x labels wide; and transitions."""

    labels: list[str]
    ids: tuple[dict[str, int], dict[str, int], dict[str, int]]
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    moves: np.ndarray
    start: np.ndarray
    listed: frozenset[str]
    _known: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None
    _sorts: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_rows": None, "_sorts": None}

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """Row number of each token in `_rows`, its share of the emissions of its neighbours; made once for each different token."""
        if len(self._known) > 400_000:
            self._known, self._rows = {}, None
        known = self._known
        if self._rows is None:
            self._rows, self._sorts = np.zeros((1, *self.tables[0].shape[1:]), np.float32), np.zeros(1, np.int8)
            known["\n"] = 0  # a line end says nothing to its neighbours
        new = list(dict.fromkeys(t for t in tokens if t not in known))
        if new:
            found = [features(t, self.listed) for t in new]
            rows = sum(table[[ids.get(f[k], 0) for f in found]] for k, (ids, table) in enumerate(zip(self.ids, self.tables, strict=True)))
            known.update(zip(new, range(len(self._rows), len(self._rows) + len(new)), strict=True))
            self._rows = np.concatenate([self._rows, rows.astype(np.float32)])
            self._sorts = np.concatenate([self._sorts, np.array([sort(t) for t in new], np.int8)])
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, tokens: list[str], first: np.ndarray) -> np.ndarray:
        """(tokens, labels); first: where each sequence starts. Sequences do not see each other."""
        rows = self.token_rows(tokens)
        reach = max(OFFSETS)
        seq = np.zeros(len(tokens), np.int64)
        seq[first[1:]] = 1
        seq = np.cumsum(seq)
        padded = np.concatenate([np.zeros(reach, np.int64), rows, np.zeros(reach, np.int64)])
        of = np.concatenate([np.full(reach, -1), seq, np.full(reach, -1)])
        out = np.zeros((len(tokens), len(self.labels)), np.float32)
        n = len(tokens)
        for k, o in enumerate(OFFSETS):
            there = slice(reach + o, reach + o + n)
            # the neighbour at +o speaks about this token through its table at offset o
            out += np.ascontiguousarray(self._rows[:, k])[np.where(of[there] == seq, padded[there], 0)]
        for slot, (at, word) in zip(LAST, last_words(self._sorts[rows], first), strict=True):
            out[at] += self._rows[rows[word], slot]
        return out

    def decode(self, tokens: list[str], first: np.ndarray) -> np.ndarray:
        """Best label of each token; label 0 is outside.

        A sequence is left outside without Viterbi if no token's best other label can gain
        more than it loses, whatever the moves: then no other path is better.
        """
        if not tokens:
            return np.zeros(0, np.int8)
        e = self.emissions(tokens, first)
        best = np.zeros(len(tokens), np.int8)
        gain = e[:, 1:].max(axis=1) - e[:, 0]
        most = max(float((self.moves - self.moves[0, 0]).max()), float((self.start - self.start[0]).max()), 0.0)
        ends = np.append(first[1:], len(tokens))
        open_ = np.flatnonzero(np.maximum.reduceat(gain, first) + 2 * most >= 0)
        lengths = (ends - first)[open_]
        order = open_[np.argsort(lengths, kind="stable")]
        lengths = np.sort(lengths)
        at = 0
        while at < len(order):
            to = int(np.searchsorted(lengths, max(lengths[at] * 1.3, lengths[at] + 4), "right"))
            to = min(to, at + max(1, 400_000 // int(lengths[to - 1])))
            block, size = order[at:to], int(lengths[to - 1])
            best_of = self._viterbi(e, first[block], lengths[at:to], size)
            cols = np.arange(size)
            inside = cols[None, :] < lengths[at:to, None]
            best[(first[block][:, None] + cols)[inside]] = best_of[inside]
            at = to
        return best

    def _viterbi(self, e: np.ndarray, first: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
        index = np.minimum(first[None, :] + np.arange(size)[:, None], len(e) - 1)
        local = e[index]  # (size, sequences, labels)
        onto = np.ascontiguousarray(self.moves.T)[None]  # to, from
        score = self.start + local[0]
        back = np.zeros((size, len(first), len(self.labels)), np.int8)
        own = np.arange(len(self.labels), dtype=np.int8)
        alive = np.searchsorted(lengths, np.arange(size), "right")  # sequences are sorted by length: those from here on go on
        for t in range(1, size):
            k = alive[t]
            way = score[k:, None, :] + onto
            back[t, k:] = way.argmax(axis=2)
            score[k:] = way.max(axis=2) + local[t, k:]
            back[t, :k] = own
        out = np.zeros((size, len(first)), np.int8)
        now = score.argmax(axis=1)
        rows = np.arange(len(first))
        for t in range(size - 1, -1, -1):
            out[t] = now
            now = back[t, rows, now]
        return out.T


class _Objective:
    """Mean negative log-likelihood of labelled sequences plus weight decay, and its gradient, over one flat vector of weights."""

    def __init__(self, values: np.ndarray, sorts: np.ndarray, sizes: list[int], lengths: np.ndarray, gold: np.ndarray, n_labels: int, decay: float):
        # values: (3, tokens) feature values of every token, sequences one after the other, shortest first
        self.n, self.lengths, self.gold, self.decay, self.n_seq = n_labels, lengths, gold, decay, len(lengths)
        ends = np.cumsum(lengths)
        self.first = ends - lengths
        seq = np.repeat(np.arange(len(lengths)), lengths)
        at, reach, columns, base = np.arange(len(seq)), (max(OFFSETS), SHAPE_REACH, SUFFIX_REACH), [], 1
        self.blocks: list[tuple[int, int, int]] = []  # feature, offset, first row of the pair in the flat table
        for k, size in enumerate(sizes):
            for j, o in enumerate(OFFSETS):
                if abs(o) > reach[k]:
                    continue
                there = np.clip(at + o, 0, len(at) - 1)
                inside = (at + o == there) & (seq[there] == seq)
                value = np.where(inside, values[k][there], 0)
                columns.append(np.where(value > 0, base + value - 1, 0))
                self.blocks.append((k, j, base))
                base += size
        for slot, (with_digits, word) in zip(LAST, last_words(sorts, self.first), strict=True):
            for k in (0, 2):
                column = np.zeros(len(at), np.int64)
                column[with_digits] = np.where(values[k][word] > 0, base + values[k][word] - 1, 0)
                columns.append(column)
                self.blocks.append((k, slot, base))
                base += sizes[k]
        self.rows = np.stack(columns, axis=1)  # row 0 has no weight
        self.height = base
        flat = self.rows.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 1) :]
        self.used, self.starts = np.unique(flat[order], return_index=True)
        self.tokens_of = order // self.rows.shape[1]
        self.right = np.eye(n_labels)[gold]
        same = seq[1:] == seq[:-1]
        self.seen = np.zeros((n_labels, n_labels))
        np.add.at(self.seen, (gold[:-1][same], gold[1:][same]), 1)

    def size(self) -> int:
        return self.height * self.n + self.n * self.n + self.n

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.height * self.n
        return w[:a].reshape(self.height, self.n), w[a : a + self.n * self.n].reshape(self.n, self.n), w[a + self.n * self.n :]

    def __call__(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        table, moves, start = self.parts(w)
        e = np.zeros((len(self.rows), self.n))
        for c in range(self.rows.shape[1]):
            e += table[self.rows[:, c]]
        error, loss = np.empty_like(e), 0.0
        gain_moves, gain_start = -self.seen, np.zeros(self.n)
        at = 0
        while at < self.n_seq:  # sequences of about the same length together
            to = int(np.searchsorted(self.lengths, max(self.lengths[at] * 1.15, self.lengths[at] + 2), "right"))
            first, lengths = self.first[at:to], self.lengths[at:to]
            longest = int(lengths[-1])
            index = np.minimum(first[None, :] + np.arange(longest)[:, None], len(e) - 1)
            live = np.arange(longest)[:, None] < lengths[None, :]
            own = e[index]
            top = own.max(axis=2)
            near, step, stop = np.exp(own - top[..., None]), np.exp(moves), live[..., None]
            # Forward and backward with every step scaled to sum 1, so that chances are plain products.
            ahead, behind, sums = np.empty_like(own), np.ones_like(own), np.ones(top.shape)
            ahead[0] = np.exp(start) * near[0]
            for t in range(longest):
                if t:
                    ahead[t] = np.where(stop[t], (ahead[t - 1] @ step) * near[t], ahead[t - 1])
                sums[t] = ahead[t].sum(axis=1)
                ahead[t] /= sums[t][:, None]
            for t in range(longest - 1, 0, -1):
                onward = near[t] * behind[t] / sums[t][:, None] * stop[t]
                gain_moves = gain_moves + step * (ahead[t - 1].T @ onward)
                behind[t - 1] = np.where(stop[t], onward @ step.T, 1.0)
            chance = ahead * behind
            error[index[live]] = chance[live]
            gain_start += chance[0].sum(axis=0)
            loss += float(np.log(sums).sum() + top[live].sum())
            at = to
        error -= self.right
        loss -= float((e * self.right).sum()) + float((moves * self.seen).sum()) + float(start[self.gold[self.first]].sum())
        gain_start -= np.bincount(self.gold[self.first], minlength=self.n)
        gain = np.zeros_like(table)
        gain[self.used] = np.add.reduceat(error[self.tokens_of], self.starts, axis=0)
        grad = np.concatenate([gain.ravel(), gain_moves.ravel(), gain_start]) / self.n_seq + self.decay * w
        return loss / self.n_seq + 0.5 * self.decay * float(w @ w), grad


def minimum(f, w: np.ndarray, tolerance: float, steps: int, memory: int = 12) -> np.ndarray:
    """The minimum of a smooth convex function by L-BFGS with a halving line search; ends when the gradient's norm is at most tolerance."""
    value, grad = f(w)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.linalg.norm(grad) <= tolerance:
            break
        way, kept = grad.copy(), []
        for s, y, r in reversed(moves):
            a = r * (s @ way)
            way -= a * y
            kept.append(a)
        if moves:
            s, y, _r = moves[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(moves, reversed(kept), strict=True):
            way += (a - r * (y @ way)) * s
        slope, size = grad @ way, 1.0 if moves else 1.0 / max(1.0, float(np.linalg.norm(grad)))
        while True:
            there, new_grad = f(w - size * way)
            if there <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size *= 0.5
        s, y = -size * way, new_grad - grad
        if s @ y > 1e-12:
            moves = [*moves[-memory + 1 :], (s, y, 1.0 / (s @ y))]
        w, value, grad = w + s, there, new_grad
    return w


def train(sequences: list[tuple[list[str], list[int]]], labels: list[str], listed: frozenset[str], decay: float = 6e-5, least: int = 2, tolerance: float = 3e-4, steps: int = 400) -> Field:
    """Maximum likelihood with weight decay over labelled sequences.

    The objective is strictly convex, so that its optimum depends on the sequences only: on
    no start, order or seed. Feature values seen fewer than `least` times have no weight.
    """
    sequences = sorted(sequences, key=lambda s: (len(s[0]), s))
    known = {t: features(t, listed) for t in {t for tokens, _ in sequences for t in tokens}}
    found = [known[t] for tokens, _ in sequences for t in tokens]
    ids: list[dict[str, int]] = []
    for k in range(3):
        counts: dict[str, int] = {}
        for x in found:
            counts[x[k]] = counts.get(x[k], 0) + 1
        ids.append({v: i for i, v in enumerate((v for v, n in sorted(counts.items()) if n >= least and v), 1)})
    values = np.array([[ids[k].get(x[k], 0) for x in found] for k in range(3)])
    sorts = np.array([sort(t) for tokens, _ in sequences for t in tokens])
    gold = np.array([y for _, ys in sequences for y in ys])
    f = _Objective(values, sorts, [len(d) for d in ids], np.array([len(t) for t, _ in sequences]), gold, len(labels), decay)
    table, moves, start = f.parts(minimum(f, np.zeros(f.size()), tolerance, steps))
    tables = [np.zeros((len(d) + 1, len(OFFSETS) + len(LAST), len(labels))) for d in ids]
    for k, j, base in f.blocks:
        tables[k][1:, j] = table[base : base + len(ids[k])]
    # Rounded, so that what is left of other processors' last digits seldom reaches a decision.
    exact = lambda x: np.round(x, 3).astype(np.float32)
    return Field(labels, tuple(ids), tuple(exact(t) for t in tables), exact(moves), exact(start), listed)
