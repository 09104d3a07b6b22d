"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled rows, on binned statistics, then flattened into arrays of features,
thresholds, children and leaf values; every document is scored by walking all rows of a batch through these arrays
with numpy, one tree level at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .quality_rules import STOP_WORDS

#: Most labelled rows that a model is fitted on; score from which a document is good.
SAMPLE_ROWS, THRESHOLD = 20_000, 0.7
#: Trees, their depth, learning rate, bins of a statistic, least hessian of a leaf, L2 penalty.
TREES, DEPTH, RATE, BINS, LEAST, PENALTY = 80, 4, 0.15, 64, 2.0, 1.0

STATISTICS = (
    "log_words", "log_lines", "mean_word", "sd_word", "max_word", "words_per_line", "distinct_words", "distinct_lines", "top_word",
    "stop_words", "letters", "capitals", "digits", "spaces", "stops", "commas", "exclaims", "symbols", "pipes", "braces", "other_marks",
    "not_ascii", "shouted_words", "digit_words", "marked_words", "repeated_windows",
)
_STOP = frozenset(w.encode() for w in STOP_WORDS)
_MARKED = re.compile(rb"[^\sA-Za-z0-9.,\x80-\xff]")


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for a whole text; zeros where there are no words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts, n, size = Counter(words), len(words), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    octets = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    of = lambda marks: float(octets[list(marks)].sum())
    number = {w: i for i, w in enumerate(counts)}
    codes = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)[1]
    windows = len(np.unique(pairs[:-1] * len(number) + codes[2:])) if n > 2 else 0
    return [
        np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(), lengths.max(), n / len(lines), len(counts) / n, len(set(lines)) / len(lines),
        max(counts.values()) / n, sum(c for w, c in counts.items() if w.lower() in _STOP) / n, float(octets[97:123].sum() + octets[65:91].sum()),
        float(octets[65:91].sum()), float(octets[48:58].sum()), of(b" \t\r\n"), of(b".?"), of(b",;:"), of(b"!"), of(b"#*$%&@^~"), of(b"|"), of(b"{}[]()<>="),
        of(b"\"'/\\_+-`"), float(octets[128:].sum()), sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        sum(c for w, c in counts.items() if any(48 <= b < 58 for b in w)) / n, sum(c for w, c in counts.items() if _MARKED.search(w)) / n,
        1 - windows / max(1, n - 2),
    ]


@dataclass
class Forest:
    """Trees as arrays, one row a tree: node i has children 2i+1 and 2i+2; below a leaf both sides repeat its value."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost regression trees on the logistic loss; without rows of both classes every score is their share (or 0.5)."""
    share = float(np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3))
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    if len(np.unique(y)) < 2:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])  # value > edge i: bin > i
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.zeros(nodes)
            for f, bins in enumerate(binned):
                place = (at - first) * BINS + bins
                g, h = (np.bincount(place, v, nodes * BINS).reshape(nodes, BINS).cumsum(1) for v in (gradient, hessian))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
                gain[(h < LEAST) | (h_all - h < LEAST)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                most = gain[np.arange(nodes), k]
                better = most > best + 1e-9
                best[better] = most[better]
                feature[first : first + nodes][better], cut[first : first + nodes][better] = f, k[better]
                threshold[first : first + nodes][better] = edges[f][k[better]]
            at = 2 * at + 1 + (binned[feature[at], np.arange(len(y))] > cut[at])
        g, h = (np.bincount(at - inner, v, inner + 1) for v in (gradient, hessian))
        leaf = -RATE * g / (h + PENALTY)
        margin += leaf[at - inner]
        trees.append((feature, threshold, leaf))
    return Forest(*(np.stack(part) for part in zip(*trees)), base)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text is 2 mod 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))



def _rows(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on ``sample_rows`` labelled rows at most, chosen by a hash of their ids; held-out ids are left out.

    Of rows of ``docs`` that share an id one is learned from, the one with the least statistics, once for each of its labels.
    """
    usable = labels.select(F.col("doc_id").alias("__ws_id"), F.col("quality").cast("double").alias("__ws_y")).dropna()
    usable = usable.where(~held_out("__ws_id"))
    share = min(1.0, sample_rows * 0.97 / max(1, usable.count()))
    chosen = usable.distinct().where(F.pmod(F.xxhash64("__ws_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample_rows)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_rows(texts)))

    rows = docs.select(F.col(id_col).alias("__ws_doc"), text_of(text_col).alias("__ws_text")).join(
        F.broadcast(chosen), F.col("__ws_doc") == F.col("__ws_id")
    )
    rows = rows.select(F.col("__ws_id").alias("id"), measured("__ws_text").alias("x"), F.col("__ws_y").alias("y"))
    got = rows.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas()  # one row for each of ``chosen`` at most
    got = got.sort_values(["id", "y"], kind="stable")
    return fit(np.array(got["x"].tolist(), np.float64).reshape(-1, len(STATISTICS)), got["y"].to_numpy())


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, never null) and predicted (1 if score >= ``threshold``, else 0).

    Only the text is an input of a score. Null and empty texts score as texts without words. Labels that are null are
    not learned from; repeated rows and labels count once. A score of exactly ``threshold`` is predicted 1; of equal
    splits a tree takes the first statistic and the lowest edge. Columns of these three names are replaced; all others
    pass through.
    """
    model = train(docs, labels, id_col, text_col, sample_rows)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_rows(texts)))

    out = docs.withColumn("held_out", held_out(id_col)).withColumn("score", score(text_of(text_col)))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
