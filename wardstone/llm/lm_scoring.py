"""LM scoring by subword lattice likelihood: a text's marginal probability over all its segmentations.

The scores of an existing vocabulary weight the pieces, and the forward recursion sums all segmentations of a word in log
space. No piece has the space's marker but at its start, so a text's segmentations are those of its words, one after the
other, and the words' marginals sum to one over all words. The corpus gives the share of words and ends, and the counts
of the base. If ``learned``, expected counts over the different words of training re-estimate the pieces' weights, and each
word of training is one more piece of its own lattice: its discounted share of the words; what the discount frees is the
share of the segmentations into pieces, so the marginals still sum to one.
Spark counts each different word once, so a word's lattice is summed once, however often the word occurs.
The words that occur most (HEAD of them at most) are broadcast with their scores; only the other words of a document
shuffle, to meet theirs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .lattice import vocabulary
from .lattice_batch import expected_counts, log_marginals

#: Smoothing of the base, and of a piece's expected count.
ALPHA, PIECE_ALPHA = 0.1, 0.1
#: Most words that are broadcast, and the most bytes of such a word.
HEAD, HEAD_BYTES = 100_000, 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def held_out(id_col: str) -> Column:
    """Rows that are not learned from: crc32 of the id as text is 0 mod 10. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def _words(raw: bytes) -> list[bytes]:
    return raw.lower().split()  # bytes: A-Z, and white space of ASCII only


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, uses, train): how often each word occurs, and occurs in rows to learn from; ``docs`` has t and held."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, held = Counter(), Counter()

        def flush() -> pd.DataFrame:
            words = list(train.keys() | held.keys())
            out = pd.DataFrame({"word": words, "uses": [train[w] + held[w] for w in words], "train": [train[w] for w in words]})
            train.clear()
            held.clear()
            return out

        for frame in frames:
            for t, out in zip(frame["t"], frame["held"].tolist()):
                (held if out else train).update(_words(t.encode("utf-8", "surrogatepass")))
            if len(train) + len(held) > 500_000:
                yield flush()
        yield flush()

    rows = docs.select("t", "held").mapInPandas(counted, "word binary, uses long, train long")
    return rows.groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("train").alias("train"))


def piece_weights(words: DataFrame, path: str | None = None) -> np.ndarray:
    """Log weights of the pieces by their expected counts over the different words of training, from the vocabulary's weights.

    A task gives one row at most for each piece of the vocabulary, and so does the driver's result.
    """
    first = np.array(vocabulary(path).weight)

    def uses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(len(first))
        for frame in frames:
            counts += expected_counts([w.decode("utf-8", "surrogatepass") for w in frame["word"]], first, path)
        piece = np.flatnonzero(counts)
        yield pd.DataFrame({"piece": piece.astype(np.int32), "n": counts[piece]})

    seen = words.where("train > 0").select("word").mapInPandas(uses, "piece int, n double")
    got = seen.groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.where(np.isfinite(first), PIECE_ALPHA, 0.0)
    counts[got["piece"].to_numpy(np.int64)] += got["n"].to_numpy(float)
    weight, usable = np.full(len(counts), -np.inf), counts > 0
    weight[usable] = np.log(counts[usable] / counts.sum())
    return weight


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, head: int = HEAD, learned: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A-Z lower-cased, and one end. base_score sums log10((c + 0.1) / (N + 0.1 (V + 1)))
    over tokens; score is the log10 of the product of the words' shares of tokens times their marginals over all
    segmentations, and of the end's share. Null and empty texts are an end alone. Repeated rows are scored each. If no
    row is to be learned from, c, N and V are 0 and words and ends have a share of half. A word of any length is summed
    in memory linear in it. Columns other than the two are not read. ``learned``: see above; without a word to learn from
    it changes nothing.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), held_out(id_col).alias("held"))
    words = stored(word_counts(base), "words")
    ends = base.where("not held").count()
    of = lambda when: F.count(F.when(when, 1))
    n_words, v_words, once, twice = words.agg(F.coalesce(F.sum("train"), F.lit(0)), of(F.col("train") > 0), of(F.col("train") == 1), of(F.col("train") == 2)).first()
    n, v = n_words + ends, v_words + (ends > 0)
    floor = n + ALPHA * (v + 1)
    end = (ends + 0.5) / (n + 1)  # never 0 or 1
    learned = learned and n_words > 0
    weight = piece_weights(words, path) if learned else np.array(vocabulary(path).weight)
    less = once / (once + 2 * twice) if once and twice else 0.5  # the discount of a count: over 0 and below 1

    @F.pandas_udf("double")
    def lattice_log10(column: pd.Series, train: pd.Series) -> pd.Series:
        log = log_marginals([w.decode("utf-8", "surrogatepass") for w in column], weight, path)
        if learned:
            own = np.maximum(train.to_numpy() - less, 0) / n_words
            log = np.logaddexp(math.log(less * v_words / n_words) + log, np.log(own, where=own > 0, out=np.full(len(own), -np.inf)))
        return pd.Series((math.log1p(-end) + log) / math.log(10))

    scored = words.select(
        "word", "uses", (F.col("train") > 0).cast("long").alias("known"), F.log10((F.col("train") + ALPHA) / F.lit(floor)).alias("base"),
        lattice_log10("word", "train").alias("lattice"),
    )
    scored = stored(scored, "scored")
    # the head: a bounded number of bounded words
    top = scored.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("uses"), "word").limit(head).select("word", "known", "base", "lattice").toArrow()
    held = docs.sparkSession.sparkContext.broadcast([top.column(i).combine_chunks().to_numpy(zero_copy_only=False) if i else top.column(0).to_pylist() for i in range(4)])
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("word", pa.binary()), ("rows", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For a document: one row with the sums over its words of the head, and a row for each other word."""
        names, *columns = held.value
        known, score, lattice = (x.tolist() for x in columns)
        place = {w: i for i, w in enumerate(names)}
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, mark, t in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), batch["t"].to_pylist()):
                counts = Counter(_words(t.encode("utf-8", "surrogatepass")))
                k, b, s = 0, 0.0, 0.0
                for word, times in counts.items():
                    i = place.get(word)
                    if i is None:
                        for column, x in zip(rows, (doc, mark, word, 0, times, 0, 0.0, 0.0)):
                            column.append(x)
                    else:
                        k += times * known[i]
                        b += times * score[i]
                        s += times * lattice[i]
                own = sum(n for w, n in counts.items() if w in place)
                for column, x in zip(rows, (doc, mark, b" %d" % (mark % 4096), 1, own, k, b, s)):  # no word has a space: meets nothing
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    marked = base.select(F.col("id").cast("long").alias("id"), F.xxhash64("t").alias("mark"), "t")
    each = marked.mapInArrow(parts, "id long, mark long, word binary, rows long, tokens long, known long, base double, lattice double")
    others = scored.select("word", F.col("known").alias("k"), F.col("base").alias("b"), F.col("lattice").alias("s"))
    zero = F.lit(0.0)
    met = each.join(others, "word", "left").groupBy("id", "mark").agg(
        F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum(F.col("known") + F.col("tokens") * F.coalesce("k", F.lit(0))).alias("known"),
        F.sum(F.col("base") + F.col("tokens") * F.coalesce("b", zero)).alias("base"), F.sum(F.col("lattice") + F.col("tokens") * F.coalesce("s", zero)).alias("lattice"),
    )
    # identical rows were summed together: share the sums out again
    met = met.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return met.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.expr("tokens div rows + 1").alias("n_tokens"),
        (F.expr("known div rows") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows") + math.log10((ends + ALPHA) / floor)).alias("base_score"), (F.col("lattice") / F.col("rows") + math.log10(end)).alias("score"),
    )
