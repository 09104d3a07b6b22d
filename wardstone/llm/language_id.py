"""Language identification by segmentation-marginalised unigrams over the pieces of a fixed public vocabulary.

A language is a distribution over the vocabulary's pieces: the counts expected of its training words when all their
segmentations weigh as the vocabulary's own scores say, mixed with these weights so that no piece is impossible. A word's
probability in a language sums all its segmentations by the forward recursion; a text's is the product over its words.
Words are runs of letters, lower-cased. A task computes each different word once for all languages.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .lattice import MARKER, forward, vocabulary
from .lattice_batch import LONG, PieceTable, by_length, piece_table
from .quality_model import held_out

#: Most rows that a language is learned from, chosen by a hash of their ids; the share of the public weights in a language.
ROWS_PER_LANGUAGE, SHARE = 4000, 0.01
#: Where no language can be told.
UNKNOWN = "und"
#: Most different words whose scores a task keeps.
HELD_WORDS = 300_000

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Lattices:
    """The lattices of words of one length: ids[k - 1][:, i] is the piece of k characters at i or -1; characters without one have bytes."""

    def __init__(self, codes: np.ndarray, table: PieceTable):
        self.m, self.n = codes.shape
        literal = codes == ord(MARKER)
        literal[:, 0] = False
        h, self.ids = np.zeros((self.m, self.n), np.uint64), []
        for k in range(1, min(table.longest, self.n) + 1):
            h = table.more(h[:, : self.n - k + 1], codes[:, k - 1 :])
            ids = table.ids(h)
            ids[literal[:, : self.n - k + 1]] = -1
            self.ids.append(ids)
        self.bare = np.nonzero(self.ids[0] < 0)  # (word, place) of characters without a piece
        chars, self.which = np.unique(codes[self.bare], return_inverse=True)
        self.spelled = [[table.vocab.bytes[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in chars]

    def logs(self, weight: np.ndarray) -> list[np.ndarray]:
        """For each k the log weights of the pieces of k characters, a last axis for each column of ``weight``."""
        out = [np.where((ids >= 0)[..., None], weight[ids], -np.inf) for ids in self.ids]
        if len(self.which):
            out[0][self.bare] = np.stack([weight[x].sum(axis=0) for x in self.spelled])[self.which]
        return out

    def forward(self, logs: list[np.ndarray]) -> np.ndarray:
        """Log sums over the segmentations of each prefix: (words, n + 1, columns)."""
        total = np.zeros((self.m, self.n + 1, logs[0].shape[-1]))
        for j in range(1, self.n + 1):
            total[:, j] = _log_sum(np.stack([total[:, j - k] + logs[k - 1][:, j - k] for k in range(1, min(len(logs), j) + 1)]))
        return total

    def expected(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, piece, expected uses of the piece in the word) under one column of weights."""
        logs = self.logs(weight[:, None])
        total = self.forward(logs)[..., 0]
        after = np.zeros((self.m, self.n + 1))
        for i in range(self.n - 1, -1, -1):
            after[:, i] = _log_sum(np.stack([logs[k - 1][:, i, 0] + after[:, i + k] for k in range(1, min(len(logs), self.n - i) + 1)]))
        rows, pieces, uses = [], [], []
        for k, (ids, log) in enumerate(zip(self.ids, logs), 1):
            share = np.exp(total[:, : self.n - k + 1] + log[..., 0] + after[:, k:] - total[:, -1:])
            at = np.nonzero(ids >= 0)
            rows.append(at[0])
            pieces.append(ids[at])
            uses.append(share[at])
            if k == 1:
                for row, which, use in zip(self.bare[0], self.which, share[self.bare]):
                    n = len(self.spelled[which])
                    rows.append(np.full(n, row))
                    pieces.append(np.array(self.spelled[which]))
                    uses.append(np.full(n, use))
        return tuple(np.concatenate(x) for x in (rows, pieces, uses))


def _log_sum(parts: np.ndarray) -> np.ndarray:
    most = parts.max(axis=0)
    return most + np.log(np.exp(parts - most).sum(axis=0))


def expected_counts(words: dict[str, float], path: str | None = None) -> np.ndarray:
    """Expected uses of each piece in weighted words, all segmentations weighed by the vocabulary's scores.

    Words of over LONG letters are learned from in parts of LONG.
    """
    table = piece_table(path)
    weight, out = np.array(table.vocab.weight), np.zeros(table.vocab.size)
    parts: Counter = Counter()
    for word, n in words.items():
        for i in range(0, len(word), LONG):
            parts[word[i : i + LONG]] += n
    names = list(parts)
    times = np.fromiter(parts.values(), np.float64, len(names))
    for part, codes in by_length(names):
        rows, pieces, uses = Lattices(codes, table).expected(weight)
        out += np.bincount(pieces, uses * times[part][rows], len(out))
    return out


@dataclass
class Languages:
    """Languages, the log share of each in the training rows, and log probabilities: one row a piece, one column a language."""

    names: list[str]
    prior: np.ndarray
    weight: np.ndarray
    path: str | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all its segmentations summed."""
        table, out = piece_table(self.path), np.zeros((len(words), len(self.names)))
        for part, codes in by_length(words, LONG):
            lattices = Lattices(codes, table)
            out[part] = lattices.forward(lattices.logs(self.weight))[:, -1]
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        columns = [column.tolist() for column in self.weight.T] if long else []
        for i in long:
            out[i] = [forward(table.vocab, MARKER + words[i], column)[-1] for column in columns]
        return out


class Scorer:
    """Texts' languages; scores of words are kept."""

    def __init__(self, model: Languages):
        self.model, self.place, self.scores = model, {}, np.zeros((0, len(model.names)))

    def _places(self, counts: list[Counter]) -> None:
        new = list(dict.fromkeys(w for c in counts for w in c if w not in self.place))
        if len(self.place) + len(new) > HELD_WORDS:
            self.place, self.scores = {}, self.scores[:0]
            new = list(dict.fromkeys(w for c in counts for w in c))
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])

    def languages(self, texts: list) -> tuple[list[str], list[float]]:
        counts = [Counter(words_of(t)) if t else Counter() for t in texts]
        if not self.model.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        self._places(counts)
        names, scores = [], []
        for c in counts:
            if not c:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))
            log = self.model.prior + np.fromiter(c.values(), np.float64, len(c)) @ self.scores[at]
            best = int(log.argmax())
            names.append(self.model.names[best])
            scores.append(float(1 / np.exp(log - log[best]).sum()))
        return names, scores


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, path: str | None = None) -> Languages:
    """Languages of the rows that are not held out; a language's rows are chosen by a hash of their ids.

    The driver gets a count for each language and piece.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Languages([], np.zeros(0), np.zeros((0, 0)), path)
    share = docs.sparkSession.createDataFrame([(x, min(1_000_000, rows_per_language * 1_000_000 // sizes[x])) for x in names], "name string, share long")
    chosen = rows.join(F.broadcast(share), F.col("lang") == F.col("name")).where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pd.DataFrame]:
            for name, words in held.items():
                uses = expected_counts(words, path)
                pieces = np.flatnonzero(uses)
                yield pd.DataFrame({"lang": name, "piece": pieces, "uses": uses[pieces]})
            held.clear()

        for frame in frames:
            for name, t in zip(frame["lang"], frame["t"]):
                held[name].update(words_of(t))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    parts = chosen.select("lang", "t").mapInPandas(counted, "lang string, piece int, uses double")
    uses = parts.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
    public = np.exp(np.array(vocabulary(path).weight))
    weight = np.zeros((len(public), len(names)))
    weight[uses["piece"].to_numpy(np.int64), uses["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)] = uses["uses"]
    total = weight.sum(axis=0)
    weight = np.where(total > 0, (1 - SHARE) * weight / np.where(total > 0, total, 1), 0) + np.where(total > 0, SHARE, 1) * public[:, None]
    n = np.array([sizes[x] for x in names], float)
    with np.errstate(divide="ignore"):
        return Languages(names, np.log(n / n.sum()), np.log(weight), path)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, path: str | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score (0 to 1: the share of that language in the text's probability over all).

    Languages are the values of ``lang_col`` of rows that are not held out and have a text. A text that is null or has no
    letter is "und" with score 0, and so are all texts if no language was learned. Of equally likely languages the
    ASCII-least is taken. Repeated rows are scored each, and learned from each. Only the text is an input of a score.
    Words of any length are summed in memory linear in them. Columns of these three names are replaced, others pass.
    """
    model = train_languages(docs, id_col, text_col, lang_col, rows_per_language, path)

    @F.pandas_udf("lang_pred string, score double")
    def told(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in frames:
            names, scores = scorer.languages(texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    found: Column = told(text_of(text_col))
    out = docs.withColumn("__ws_found", found).withColumn("held_out", held_out(id_col))
    return out.withColumns({"lang_pred": F.col("__ws_found.lang_pred"), "score": F.col("__ws_found.score")}).drop("__ws_found")
