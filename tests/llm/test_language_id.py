"""Language identification: lattices against enumeration, held-out accuracy, edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import queries
from wardstone.llm.language_id import Languages, Scorer, expected_counts, identify_languages, words_of
from wardstone.llm.lattice import MARKER, vocabulary

WORDS = ["the", "hello", "éte", "漢字", "ab\U0001f600c"]


def segmentations(word):
    def back(j):
        if j == 0:
            yield ()
            return
        for i, ids in vocabulary().ending(word, j):
            for rest in back(i):
                yield rest + ids

    return list(back(len(word)))


@pytest.mark.parametrize("word", WORDS)
def test_expected_counts_equal_enumeration(word):
    weight = vocabulary().weight
    each = {s: math.exp(sum(weight[x] for x in s)) for s in segmentations(MARKER + word)}
    want = np.zeros(vocabulary().size)
    for s, p in each.items():
        for x in s:
            want[x] += 3 * p / sum(each.values())
    assert np.allclose(expected_counts({word: 3}), want)


def test_word_scores_sum_all_segmentations():
    rng = np.random.default_rng(4)
    weight = np.log(rng.dirichlet(np.ones(vocabulary().size), 3).T)
    model = Languages(["a", "b", "c"], np.log(np.ones(3) / 3), weight)
    got = model.word_scores(WORDS + ["w" * 600])
    for i, word in enumerate(WORDS):
        for j in range(3):
            assert math.isclose(got[i, j], math.log(sum(math.exp(sum(weight[x, j] for x in s)) for s in segmentations(MARKER + word))))
    assert np.isfinite(got).all()
    names, scores = Scorer(model).languages(["hello the the", "", None, "12 !", "the hello the"])
    total = [sum(n * got[WORDS.index(w)] for w, n in (("hello", 1), ("the", 2)))]
    best = int(np.argmax(total[0]))
    assert names == ["abc"[best], "und", "und", "und", "abc"[best]] and scores[1:4] == [0, 0, 0]
    assert math.isclose(scores[0], 1 / np.exp(total[0] - total[0][best]).sum()) and math.isclose(scores[0], scores[4])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


SCHEMA = "doc_id long, text string, lang string"


def test_edges(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["uno", "dos", "tres"] if i % 2 else ["one", "two", "three"]) for _ in range(9)), "es" if i % 2 else "en") for i in range(80)]
    odd = [(100, None, "en"), (101, "", "es"), (102, "12 34 !?", "en"), (103, "漢" * 5000, None), (104, "two\n" * 100_000, None), (105, "DOS, Tres!", "en"), (105, "DOS, Tres!", "en"), (None, "three", None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5).select("*", *(F.lit(i).alias(x) for i, x in enumerate(("score", "held_out", "id", "t", "n", "name", "share"))))
    got = identify_languages(df)
    assert {"score", "held_out", "id", "t", "name"} <= set(got.columns) and got.count() == len(rows) + len(odd)
    told = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got.collect()}
    assert all(told[i, t][0] == lang for i, t, lang in rows)
    assert [told[i, t] for i, t, _ in odd[:3]] == [("und", 0.0)] * 3
    assert [told[i, t][0] for i, t, _ in odd[4:]] == ["en", "es", "es", "en"] and told[odd[3][:2]][0] in ("en", "es")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "hello", None), (2, None, "en")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in identify_languages(df).collect()] == [("und", 0.0)] * 2
    assert identify_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words():
    assert words_of("DÜ éx2 a-b ١٢") == ["dü", "éx", "a", "b"]
