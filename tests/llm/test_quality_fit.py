"""The classifier's fit against an exhaustive search, and labels that repeat or contradict each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.llm import quality_model
from wardstone.llm.quality_model import LEAST, PENALTY, RATE, fit, score_quality


def gain(g, h, left):
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + PENALTY)
    return part(left) + part(~left) - part(np.ones(len(g), bool))


@pytest.mark.parametrize("seed", range(6))
def test_a_tree_takes_the_best_split_of_all(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.permutation(np.repeat(np.arange(30), 10)) for _ in range(5)], axis=1).astype(float)
    y = (x[:, seed % 5] + 6 * rng.normal(size=300) > 15).astype(float)
    monkeypatch.setattr(quality_model, "TREES", 1)
    monkeypatch.setattr(quality_model, "DEPTH", 1)
    model = fit(x, y)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(300, p * (1 - p))
    ways = {(f, v): gain(g, h, x[:, f] <= v) for f in range(5) for v in range(29) if min(h[x[:, f] <= v].sum(), h[x[:, f] > v].sum()) >= LEAST}
    f, threshold = int(model.feature[0, 0]), model.threshold[0, 0]
    left = x[:, f] <= threshold
    assert np.isclose(gain(g, h, left), max(ways.values()))
    for side, leaf in ((left, model.leaf[0, 0]), (~left, model.leaf[0, 1])):
        assert np.isclose(leaf, -RATE * g[side].sum() / (h[side].sum() + PENALTY))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.base + np.where(left, model.leaf[0, 0], model.leaf[0, 1])))))


def test_repeated_and_contradicting_labels(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (3 + i % 40) + ("good text." if i % 2 else "@@@@ ####")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    scores = lambda rows: {r["doc_id"]: round(r["score"], 12) for r in score_quality(docs, rows).collect()}
    want = scores(labels)
    assert scores(labels.union(labels).union(labels.select("doc_id", F.lit(None).cast("int")))) == want  # repeats and nulls count once, or not at all
    both = scores(labels.union(labels.select("doc_id", 1 - F.col("quality"))))
    assert all(abs(x - 0.5) < 1e-6 for x in both.values())  # each text is good and bad: no split tells anything
