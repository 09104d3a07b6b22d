"""op5's learned weights: near the base on rows held out, and still the sum over every segmentation."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardstone.llm.lattice import MARKER, forward, vocabulary
from wardstone.llm.lattice_batch import LONG, expected_counts
from wardstone.llm.lm_scoring import PIECE_ALPHA, lm_scores
from wardstone.llm.queries import QUERIES


def segmentations(word):
    def back(j):
        if j == 0:
            yield ()
            return
        for i, ids in vocabulary().ending(word, j):
            for rest in back(i):
                yield rest + ids

    return list(back(len(word)))


def test_held_out_scores_are_near_the_base(spark):
    got = QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base, bad, n = got.agg(F.sum("score"), F.sum("base_score"), F.count(F.when(~F.col("score").between(-1e300, 0), 1)), F.count("*")).first()
    assert n > 0 and bad == 0 and score > 1.15 * base


def test_learned_scores_equal_enumeration(spark):
    """Pieces by their expected counts over the words of training; a word of training is one more piece."""
    rows, weight = [(1, "the cat the"), (2, "A▁b été"), (3, "hello\thello 漢x"), (4, "cat the dog"), (5, ""), (38, "unseen cats"), (None, "dog")], vocabulary().weight
    train, words, ends = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 != 0, Counter(), 0
    for d, t in rows:
        if train(d):
            words.update(t.lower().split())
            ends += 1
    counts = np.where(np.isfinite(weight), PIECE_ALPHA, 0.0)
    for w in words:
        each = segmentations(MARKER + w)
        p = [math.exp(sum(weight[x] for x in s)) for s in each]
        for s, x in zip(each, p):
            np.add.at(counts, list(s), x / sum(p))
    with np.errstate(divide="ignore"):
        fitted, total = np.log(counts / counts.sum()), words.total()
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    less, end = once / (once + 2 * twice) if once and twice else 0.5, (ends + 0.5) / (total + ends + 1)

    def share(w):
        pieces = sum(math.exp(sum(fitted[x] for x in s)) for s in segmentations(MARKER + w))
        return max(words[w] - less, 0) / total + less * len(words) / total * pieces

    got = lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), learned=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert math.isclose(r["score"], math.log10(end) + sum(math.log10((1 - end) * share(w)) for w in text.lower().split()), rel_tol=1e-9)


def test_expected_counts_of_long_words():
    weight = np.array(vocabulary().weight)
    word = "abcé漢the▁x" * 25
    assert len(word) <= LONG
    got = expected_counts([word, word + "the" * 3], weight)
    by_one = [x for w in (word, word + "the" * 3) for x in [(forward(vocabulary(), MARKER + w, weight.tolist()), MARKER + w)]]
    counts = np.zeros(len(weight))
    for total, w in by_one:  # the uses by hand, with sums from both ends
        share = np.zeros(len(w) + 1)
        share[-1] = 1
        for j in range(len(w), 0, -1):
            for i, ids in vocabulary().ending(w, j):
                use = share[j] * math.exp(total[i] + sum(weight[x] for x in ids) - total[j])
                share[i] += use
                np.add.at(counts, list(ids), use)
    assert np.allclose(got, counts)


def test_nothing_to_learn_from(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "the cat")], "doc_id long, text string")
    assert lm_scores(docs, learned=True).collect() == lm_scores(docs).collect()
    assert lm_scores(docs.limit(0), learned=True).count() == 0
