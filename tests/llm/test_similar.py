"""Groups of similar texts against brute force over all pairs."""

import random

import pytest
from test_dedup import ROWS, brute_fingerprint, clash, frame

from wardstone.llm.simhash import near_dedup
from wardstone.llm.similar import similar_groups


def brute_set(text, shingle=5):
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1)))


def similar(a, b, least=(4, 5)):
    return a == b or len(a & b) * least[1] >= len(a | b) * least[0] > 0


def brute_groups(rows):
    sets, part = [brute_set(t or "") for _, t in rows], list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                part[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_rows(seed=3):
    """Copies at similarities on both sides of 0.8, of texts of 4 to 400 words, some with a passage that many have."""
    rng, out = random.Random(seed), []
    common = [f"license{i}" for i in range(30)]
    for i in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([4, 8, 9, 30, 120, 400]))] + (common if i % 3 == 0 else [])
        for k in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = f"changed{rng.random()}"
            out.append((1000 + len(out), " ".join(copy[: len(copy) - rng.randint(0, 1 + len(copy) // 20)])))
    rng.shuffle(out)
    return out


def test_similar_groups(spark):
    rows = [*ROWS, *near_rows()]
    got = [(r["doc_id"], r["component_id"]) for r in similar_groups(clash(frame(spark, rows))).collect()]
    assert sorted(got, key=str) == brute_groups(rows)
    assert similar_groups(frame(spark, [])).count() == 0
    kept = near_dedup(clash(frame(spark, rows)), similarity=0.8)
    assert kept.columns == clash(frame(spark)).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_groups(rows)})
    with pytest.raises(ValueError):
        similar_groups(frame(spark), similarity=0)


def test_late_shingles_and_parts_of_buckets_change_nothing(spark):
    """Frequent shingles come last and buckets are dealt out in parts: the links are those of brute force all the same."""
    rng = random.Random(9)
    notice = [f"notice{i}" for i in range(40)]
    own = [" ".join([*(f"w{rng.randint(0, 9999)}" for _ in range(rng.choice([3, 10, 60]))), *notice]) for _ in range(60)]
    rows = [*near_rows(4), *enumerate(own)]
    for more in ({"part": 5, "square": 3}, {"square": 2, "exact": True}, {"block": 150, "blocks": 1}):
        got = similar_groups(clash(frame(spark, rows)), crowd=3, share=1, **more).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_groups(rows)


def test_a_crowd_of_similar_texts(spark):
    """One word of 300 changed in each copy: all are one group, though few fingerprints are within op1's 3 bits."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(i, " ".join([*words[: 2 * i % 290], f"new{i}", *words[2 * i % 290 + 1 :], f"end{i}"])) for i in range(400)]
    assert {r["component_id"] for r in similar_groups(frame(spark, rows)).collect()} == {0}


def test_a_crowd_around_the_threshold(spark):
    """Copies changed more and less: most pairs are a little under 0.8, some groups and single texts stay apart."""
    rng = random.Random(11)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        changed = {rng.randrange(120) for _ in range(rng.randint(1, 6))}
        rows.append((i, " ".join(f"n{rng.randint(0, 10**6)}" if k in changed else w for k, w in enumerate(words))))
    want = brute_groups(rows)
    assert 1 < len({c for _, c in want}) < 150
    for more in ({}, {"block": 2000}, {"square": 20, "block": 2000, "blocks": 2}):
        got = similar_groups(frame(spark, rows), **more).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_pipeline_stage_joins_similar_texts(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = near_rows()
    apart = [(d, t) for d, t in rows if brute_fingerprint(t)]
    got = sorted(r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, apart), sf).collect())
    assert got == sorted({c for _, c in brute_groups(apart)})


def test_large_buckets_are_dealt_out_by_the_other_segment(spark):
    from wardstone.llm.simhash import near_links

    rng = random.Random(6)
    low = rng.getrandbits(32)
    prints = {rng.getrandbits(32) << 32 | low ^ (1 << rng.randrange(32) if rng.random() < 0.3 else 0) for _ in range(300)}
    for p in list(prints)[:80]:
        prints.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    near = {(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}

    def parts(links):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        least: dict = {}
        for x in signed:
            least[find(x)] = min(x, least.get(find(x), x))
        return {x: least[find(x)] for x in signed}

    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    for large in (1 << 16, 4):
        got = [tuple(r) for r in near_links(df, large, 1).collect()]
        assert parts(got) == parts(near)
