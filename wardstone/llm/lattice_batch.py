"""Forward sums over the lattices of many words at once, in log space where they are small, and expected uses of pieces, by numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .lattice import MARKER, forward, vocabulary

_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: Words of one matrix; words of more characters are summed one by one.
ROWS, LONG = 4096, 256
#: Sums under this go by log space.
LEAST = 1e-250


class PieceTable:
    """Ids of pieces by a hash of their characters and length, in an open table; what may start a longer piece is marked."""

    def __init__(self, path: str | None):
        vocab = vocabulary(path)
        self.vocab, self.longest = vocab, vocab.longest
        self.bits = 20
        size = 1 << self.bits
        self.keys, self.values, self.held, self.starts = np.zeros(size, np.uint64), np.full(size, -1, np.int64), np.zeros(size, bool), np.zeros(size, bool)
        by_size: dict[int, list[str]] = {}
        for piece in vocab.ids:
            by_size.setdefault(len(piece), []).append(piece)
        for n, pieces in by_size.items():
            codes = np.array([[ord(c) for c in piece] for piece in pieces], np.uint64)
            h = np.zeros(len(pieces), np.uint64)
            for i in range(n):
                h = self.more(h, codes[:, i])
                if i < n - 1:
                    self.starts[self.place(h)] = True
            for piece, x, at in zip(pieces, h, self.place(h).tolist()):
                if not x:
                    raise ValueError("a piece has the hash of an empty place")
                self.held[at] = True
                while self.values[at] >= 0:
                    if self.keys[at] == x:
                        raise ValueError("two pieces of one hash")
                    at = (at + 1) & (size - 1)
                self.keys[at], self.values[at] = x, vocab.ids[piece]

    @staticmethod
    def more(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h * _BASE + c + np.uint64(1)) * _MIX

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = self.place(h)
        key = self.keys[at]
        out = np.where(key == h, self.values[at], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))  # few: another piece's place
        at, h, flat = at.ravel()[open_], h.ravel()[open_], out.ravel()
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            key = self.keys[at]
            hit = key == h
            flat[open_[hit]] = self.values[at[hit]]
            go = ~hit & (key != 0)
            open_, at, h = open_[go], at[go], h[go]
        return flat.reshape(out.shape)

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For words of one length as columns of ``codes``: (characters, where in ``codes`` read row by row, piece) of all edges that are pieces.

        What starts no longer piece is left out from there on.
        """
        n, m = codes.shape
        flat, start, h = codes.ravel(), np.arange(n * m), np.zeros(n * m, np.uint64)
        for k in range(1, min(self.longest, n) + 1):
            h = self.more(h, flat[start + (k - 1) * m])
            at = self.place(h)
            hit = np.flatnonzero(self.held[at])
            ids = self.ids(h[hit])
            yield k, start[hit[ids >= 0]], ids[ids >= 0]
            go = np.flatnonzero(self.starts[at])
            go = go[: np.searchsorted(start[go], (n - k) * m)]
            start, h = start[go], h[go]


@lru_cache(maxsize=2)
def piece_table(path: str | None = None) -> PieceTable:
    return PieceTable(path)


def by_length(words: list[str], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, matrix of code points with the marker first) of words of one length, ``most`` at most."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= most] if most is not None else order
    starts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0]) if len(order) else []
    for group in np.split(order, starts[1:]) if len(order) else []:
        n = int(lengths[group[0]])
        step = max(1, ROWS * 16 // (n + 1) if n > 16 else ROWS)
        for a in range(0, len(group), step):
            part = group[a : a + step]
            flat = "".join(MARKER + words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(flat, np.uint32).reshape(len(part), n + 1).astype(np.uint64)


class Batch:
    """The lattices of words of one length: ids[k - 1, i] are the pieces of k characters at i, or -1, one for each word.

    Prefixes are summed as they are; where a sum comes near the least of numbers, all are summed in log space.
    """

    def __init__(self, codes: np.ndarray, table: PieceTable, weight: np.ndarray):
        m, n = codes.shape
        self.n, self.codes = n, np.ascontiguousarray(codes.T)
        most = min(table.longest, n)
        self.ids, self.parts = np.full((most, n, m), -1, np.int32), np.zeros((most, n, m))
        literal = self.codes == ord(MARKER)
        literal[0] = False
        barred = literal.any()
        for k, at, ids in table.edges(self.codes):
            if barred:  # no piece starts at a literal marker
                free = ~literal.ravel()[at]
                at, ids = at[free], ids[free]
            self.ids[k - 1].ravel()[at] = ids
            self.parts[k - 1].ravel()[at] = np.exp(weight[ids])
        self.spelled, self.none = [], self.ids[0] < 0  # characters without a piece: their bytes
        if self.none.any():
            chars, self.at = np.unique(self.codes[self.none], return_inverse=True)
            self.spelled = [[table.vocab.bytes[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in chars]
            self.parts[0][self.none] = np.exp(np.array([weight[x].sum() for x in self.spelled]))[self.at]
        used = self.parts.any(axis=2)
        self.steps = [[], *([k for k in range(1, min(most, j) + 1) if used[k - 1, j - k]] for j in range(1, n + 1))]
        self.total, self.logs = np.ones((n + 1, m)), None
        for j in range(1, n + 1):
            self.total[j] = sum(self.total[j - k] * self.parts[k - 1, j - k] for k in self.steps[j])
        if self.total.min() < LEAST:
            with np.errstate(divide="ignore"):
                self.logs = np.log(self.parts)
            self.total[0] = 0
            for j in range(1, n + 1):
                ways = np.stack([self.total[j - k] + self.logs[k - 1, j - k] for k in self.steps[j]])
                high = ways.max(axis=0)
                self.total[j] = high + np.log(np.exp(ways - high).sum(axis=0))

    def last(self) -> np.ndarray:
        """Log of the summed weight of all segmentations of each word."""
        return self.total[-1] if self.logs is not None else np.log(self.total[-1])

    def share(self, j: int, k: int) -> np.ndarray:
        """For each word, the share of the edge of ``k`` characters among those that end at ``j``."""
        if self.logs is not None:
            return np.exp(self.total[j - k] + self.logs[k - 1, j - k] - self.total[j])
        return self.total[j - k] * self.parts[k - 1, j - k] / self.total[j]

    def expected(self, counts: np.ndarray) -> None:
        """Add the expected uses of each piece in the words to ``counts``."""
        share, uses = np.zeros_like(self.total), np.zeros(self.parts.shape)
        share[self.n] = 1
        for j in range(self.n, 0, -1):
            for k in self.steps[j]:
                use = share[j] * self.share(j, k)
                uses[k - 1, j - k] = use
                share[j - k] += use
        found = np.flatnonzero(uses)
        ids, use = self.ids.ravel()[found], uses.ravel()[found]
        own = ids >= 0
        counts += np.bincount(ids[own], use[own], len(counts))
        if self.spelled:
            for spelled, amount in zip(self.spelled, np.bincount(self.at.ravel(), uses[0][self.none], len(self.spelled))):
                np.add.at(counts, spelled, amount)

    def shares(self, j: int) -> np.ndarray:
        """For each word, the cumulative shares of the edges of 1, 2, ... characters that end at ``j``, up to the longest in any word."""
        out = np.zeros((self.total.shape[1], self.steps[j][-1]))
        for k in self.steps[j]:
            out[:, k - 1] = self.share(j, k)
        return out.cumsum(axis=1)


def log_marginals(words: list[str], weight: np.ndarray, path: str | None = None) -> np.ndarray:
    out, table = np.zeros(len(words)), piece_table(path)
    for part, codes in by_length(words, LONG):
        out[part] = Batch(codes, table, weight).last()
    listed = weight.tolist()
    for i in (i for i, w in enumerate(words) if len(w) > LONG):
        out[i] = forward(table.vocab, MARKER + words[i], listed)[-1]
    return out


def expected_counts(words: list[str], weight: np.ndarray, path: str | None = None) -> np.ndarray:
    """The expected uses of each piece, over all segmentations of each of ``words``."""
    table = piece_table(path)
    counts, listed, vocab = np.zeros(table.vocab.size), weight.tolist(), table.vocab
    for _, codes in by_length(words, LONG):
        Batch(codes, table, weight).expected(counts)
    for word in (MARKER + w for w in words if len(w) > LONG):
        total, share = forward(vocab, word, listed), np.zeros(len(word) + 1)
        share[-1] = 1
        for j in range(len(word), 0, -1):
            for i, ids in vocab.ending(word, j):
                use = share[j] * math.exp(total[i] + sum([listed[x] for x in ids]) - total[j])
                share[i] += use
                np.add.at(counts, list(ids), use)
    return counts
