"""The near stage goes by the deletion variants of fingerprints first; the similarity decides, and finds the rest."""

import random

from wardstone.llm import simhash
from wardstone.llm.simhash import near_dedup
from wardstone.llm.similar import shingle_set


def test_signatures_come_first(spark, monkeypatch):
    draw, links = random.Random(5), []
    base = [" ".join(f"w{draw.randrange(9999)}" for _ in range(400)) for _ in range(12)]
    rows = [(10 * i, t) for i, t in enumerate(base)]
    rows += [(10 * i + 1, t + " end") for i, t in enumerate(base)]  # a bit or none
    rows += [(10 * i + 2, " ".join("x" if n % 97 == 50 else w for n, w in enumerate(t.split()))) for i, t in enumerate(base)]  # some bits
    rows += [(10 * i + 3, " ".join(t.split()[:250]) + f" tail{i}") for i, t in enumerate(base)]  # too unlike
    rows += [(200, None), (201, ""), (202, "short"), (203, "short"), (None, "short")]
    held = simhash.near_links

    def spy(fingerprints):
        found = held(fingerprints)
        links.append((fingerprints.select("fp").distinct().count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "near_links", spy)
    got = sorted(r["doc_id"] for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similarity=0.8).collect())
    assert len(links) == 1 and links[0][1] >= 6  # most of the twelve that have a word more

    sets, keep = {d: set(shingle_set(t or "", 5).tolist()) for d, t in rows if d is not None}, []
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    keep = sorted(d for d in root if root[d] == d)
    assert got == keep
