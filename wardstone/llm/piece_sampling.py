"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

Forward filtering sums the weights of all segmentations of each prefix of a word; backward sampling then draws the
pieces from the end, each in proportion to its share. The draws of a row come from a generator seeded by the row's key
and are dealt out by place in the text, so a row gives the same pieces on every run and in every partition. A task
filters each different word of some texts once, and draws for all its occurrences together.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .lattice import MARKER, forward, vocabulary
from .lattice_batch import Batch, by_length, piece_table

#: Seed of all draws, and sharpness: a segmentation's weight is raised to this power.
SEED, SHARPNESS = 17, 0.5
#: Characters of texts that are handled together.
TOGETHER = 1 << 20
#: Words of more characters go one by one.
LONG = 256


class Sampler:
    def __init__(self, path: str | None, sharpness: float):
        self.vocabulary, self.table = vocabulary(path), piece_table(path)
        self.weight = np.array(self.vocabulary.weight) * sharpness

    def _draw(self, batch: Batch, words: np.ndarray, draws: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For occurrences of a batch's words (rows ``words``, draws from ``at`` on): pieces from the end on, and how many.

        A character that its bytes spell stands as its code point above the vocabulary's ids.
        """
        size, n = self.vocabulary.size, batch.n
        place, count = np.full(len(words), n), np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(n, 0, -1):
            here = np.flatnonzero(place == j)
            if not len(here):
                continue
            row, share = words[here], batch.shares(j)
            pick = (share[row] <= (draws[at[here] + count[here]] * share[row, -1])[:, None]).sum(axis=1)
            pick = np.minimum(pick, share.shape[1] - 1)
            start = j - 1 - pick
            ids = batch.ids[pick, start, row].astype(np.int64)
            bare = np.flatnonzero(ids < 0)  # always of one character: any longer edge is a piece
            ids[bare] = size + batch.codes[start[bare], row[bare]].astype(np.int64)
            found.append((here, count[here], ids))
            place[here] = start
            count[here] += 1
        pieces = np.full((len(words), int(count.max(initial=0))), -1, np.int64)
        for here, step, ids in found:
            pieces[here, step] = ids
        return pieces, count

    def _long(self, part: str, draws: np.ndarray) -> np.ndarray:
        """The pieces of one word from the end on, without a matrix; memory is linear in the word."""
        vocab, weight, word = self.vocabulary, self.weight.tolist(), MARKER + part
        total, back, j, size = forward(vocab, word, weight), array("q"), len(word), vocab.size
        for draw in draws:
            edges = vocab.ending(word, j)[::-1]  # the shortest first, as a matrix has them
            shares = list(accumulate(math.exp(total[i] + sum([weight[x] for x in ids]) - total[j]) for i, ids in edges))
            start, ids = edges[min(bisect_right(shares, draw * shares[-1]), len(edges) - 1)]
            back.append(ids[0] if ids[0] in vocab.whole else size + ord(word[start]))
            j = start
            if not j:
                break
        return np.array(back, np.int64)

    def _some(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        index: dict[str, int] = {}
        words, lengths, per_text, draws = [], [], [], []
        for text, key in zip(texts, keys):
            parts = text.split(" ") if text else []
            words += [index.setdefault(p, len(index)) for p in parts]
            lengths += map(len, parts)
            per_text.append(len(parts))
            if text:  # a draw for each character, and for the marker of each word
                draws.append(np.random.Generator(np.random.Philox(key=key & 0xFFFFFFFFFFFFFFFF)).random(len(text) + 1))
        if not words:
            return [np.zeros(0, np.int32) for _ in texts]
        words, lengths, draws = np.array(words), np.array(lengths), np.concatenate(draws)
        at = np.r_[0, (lengths + 1).cumsum()[:-1]]
        by_word = np.argsort(words, kind="stable")
        edges = np.r_[np.searchsorted(words[by_word], np.arange(len(index))), len(words)]
        counts, parts = np.zeros(len(words), np.int64), []
        names = list(index)
        for i, name in enumerate(names):
            if len(name) > LONG:
                for use in by_word[edges[i] : edges[i + 1]].tolist():
                    pieces = self._long(name, draws[at[use] : at[use] + len(name) + 1])
                    counts[use] = len(pieces)
                    parts.append((np.array([use]), pieces[None, :], counts[use : use + 1]))
        for group, codes in by_length(names, LONG):
            batch = Batch(codes, self.table, self.weight)
            many = edges[group + 1] - edges[group]
            uses = by_word[np.repeat(edges[group] - np.r_[0, many.cumsum()[:-1]], many) + np.arange(many.sum())]
            pieces, count = self._draw(batch, np.repeat(np.arange(len(group)), many), draws, at[uses])
            counts[uses] = count
            parts.append((uses, pieces, count))
        ends = counts.cumsum()
        flat = np.empty(int(ends[-1]), np.int64)
        for uses, pieces, count in parts:
            row, step = np.nonzero(np.arange(pieces.shape[1]) < count[:, None])
            flat[ends[uses[row]] - 1 - step] = pieces[row, step]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(per_text)]]
        return self._spelled(flat, bounds)

    def _spelled(self, flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The texts' pieces, with the bytes of characters that have no piece."""
        size, octets = self.vocabulary.size, self.vocabulary.bytes
        other = np.flatnonzero(flat >= size)
        if len(other):
            chars, which = np.unique(flat[other] - size, return_inverse=True)
            spelled = [[octets[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in chars]
            more = np.ones(len(flat), np.int64)
            more[other] = np.array([len(x) for x in spelled])[which]
            starts = np.r_[0, more.cumsum()]
            flat, bounds, first = np.repeat(flat, more), starts[bounds], starts[other]
            for i, ids in enumerate(spelled):
                for step, x in enumerate(ids):
                    flat[first[which == i] + step] = x
        flat = flat.astype(np.int32)
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def __call__(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """The pieces of each text."""
        out, a, held = [], 0, 0
        for b, text in enumerate(texts, 1):
            held += len(text)
            if held >= TOGETHER or b == len(texts):
                out += self._some(texts[a:b], keys[a:b])
                a, held = b, 0
        return out


def sample_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, seed: int = SEED, sharpness: float = SHARPNESS
) -> DataFrame:
    """``docs`` with pieces (array<int>), one sampled segmentation of each whole text.

    ``path``: a SentencePiece model file with byte pieces. The key of a row is its id; rows that share an id and a
    text get the same pieces, and all null ids count as one key. Null and empty texts have no pieces. A column named
    pieces is replaced, all others pass through. An empty table gives an empty result.
    """

    @F.pandas_udf("array<int>")
    def sampled(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sampler = Sampler(path, sharpness)
        for texts, keys in frames:
            yield pd.Series(sampler(texts.tolist(), keys.tolist()), dtype=object)

    return docs.withColumn("pieces", sampled(text_of(text_col), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))))


def decode_pieces(rows: DataFrame, pieces_col: str = "pieces", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the text of each segmentation; null and empty ones give ''. A column named ``out_col`` is replaced."""

    @F.pandas_udf("string")
    def decoded(pieces: pd.Series) -> pd.Series:
        decode = vocabulary(path).decode
        return pd.Series([decode(p.tolist()) for p in pieces], dtype=object)

    return rows.withColumn(out_col, decoded(F.coalesce(F.col(pieces_col), F.array().cast("array<int>"))))
