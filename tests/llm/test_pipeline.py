"""The whole pipeline, through ``run``, against plain Python over a small corpus; trees walked one node at a time."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import brute_pieces
from test_similar import brute_set, similar

from wardstone.llm.quality_model import DEPTH, THRESHOLD, fit, score_quality, statistics

GOOD = "the of and to in is was for on that by with it as river stone house garden winter letter morning quiet window road people water story child".split()


def corpus():
    """Rows (doc_id, text) and labels (doc_id, quality): prose and junk, exact and near copies, a shared passage, a null, repeats."""
    rng, rows = random.Random(11), []
    prose = lambda n: " ".join(rng.choice(GOOD) + rng.choice(["", "", "s", ",", "."]) for _ in range(n))
    passage = "this passage stands in many of the documents and is much longer than fifty bytes of text, " * 2
    for i in range(80):
        rows.append((i, prose(rng.randint(60, 160)) + ("\n" + passage + "\n" + prose(20) if i % 5 == 0 else "")))
    for i in range(80, 140):
        rows.append((i, " ".join(rng.choice(["$$$", "CLICK", "!!!", "99%", "|||", "WIN", "###"]) for _ in range(rng.randint(5, 80)))))
    labels = [(d, int(d < 80)) for d, _ in rows]
    rows += [(200 + i, re.sub(" ", "  ", rows[i][1], count=3)) for i in range(10)]  # equal but for white space, and longer
    for i in range(20, 32):
        words = rows[i][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n"), (30, rows[30][1]), (30, rows[30][1]), (403, "É" * 70 + " " + prose(80)), (404, "x" + "É" * 70 + " " + prose(80)), (None, rows[40][1]), (None, prose(90))]
    rng.shuffle(rows)
    return rows, labels


def walked(forest, x):
    """The margin of one row by walking each tree from its root."""

    def leaf(tree, node, depth):
        if depth == DEPTH:
            return forest.leaf[tree][node - (2**DEPTH - 1)]
        right = x[forest.feature[tree][node]] > forest.threshold[tree][node]
        return leaf(tree, 2 * node + 1 + int(right), depth + 1)

    return forest.base + sum(leaf(t, 0, 0) for t in range(len(forest.feature)))


def brute_scores(rows, labels):
    first: dict = {}
    for d, t in rows:
        if d is not None:
            first[d] = min(statistics(t or ""), first.get(d, statistics(t or "")))
    usable = sorted((d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2 and d in first)
    forest = fit(np.array([first[d] for d, _ in usable]), np.array([float(y) for _, y in usable]))
    return [1 / (1 + np.exp(-walked(forest, statistics(t or "")))) for _, t in rows]


def brute_pipeline(rows, labels):
    """What is left after the four stages that filter, as (doc_id, text)."""
    rows = [r for r, s in zip(rows, brute_scores(rows, labels)) if s >= THRESHOLD]
    best: dict = {}
    for d, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        rank = (-len(t or ""), d is None, d or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, d, t)
    rows = [(d, t) for _, d, t in best.values()]
    sets, part = [brute_set(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                part[find(i)] = find(j)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    first: dict = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            first[raw[i : i + 50]] = min(d, first.get(raw[i : i + 50], d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, bytes(x for x, g in zip(raw, gone) if not g).decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    where = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    clash = [F.lit(i).alias(c) for i, c in enumerate(("score", "held_out", "hash", "node", "label", "mark", "runs", "piece", "length", "lang", "source"))]
    docs.select("*", *clash).repartition(6).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{where}/labels.parquet")
    return where


def test_scores_equal_a_walk_of_the_trees(spark, folder):
    rows, labels = corpus()
    got = score_quality(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))).select("doc_id", "text", "score").collect()
    want = sorted((str((d, t)), s) for (d, t), s in zip(rows, brute_scores(rows, labels)))
    assert np.allclose([s for _, s in sorted((str((r["doc_id"], r["text"])), r["score"]) for r in got)], [s for _, s in want])


def test_run_equals_brute_force(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = corpus()
    want = brute_pipeline(rows, labels)
    got = corpus_pipeline.run(spark, folder).collect()
    assert 60 < len(want) < 110 and any(len(t) < len(dict(rows)[d] or "") - 50 for d, t in want if d is not None)
    key = lambda r: (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(brute_pieces(want, 2048))
    placed: dict = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(placed) <= -(-sum(r["length"] for r in got) // 2048) + 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
