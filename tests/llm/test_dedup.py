"""Exact, line, near and passage dedup against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstone.llm import bloom, suffix_dedup
from wardstone.llm.bloom import SENT_SCHEMA, column_filter, layout, repeat_filters, sent
from wardstone.llm.exact_dedup import exact_dedup, exact_groups
from wardstone.llm.line_dedup import line_dedup
from wardstone.llm.simhash import fingerprint, near_dedup, simhash_groups
from wardstone.llm.suffix_dedup import _sorter, anchors, suffix_array_dedup
from wardstone.llm.suffix_sort import suffix_order

LONG = " ".join(f"word{i % 977} of a very long text" for i in range(5_000))
BASE = "The quick brown fox jumps over the lazy dog while seven wizards pack a dozen liquor jugs. "
ROWS = [
    (1, BASE), (2, BASE + " "), (3, "  " + BASE), (4, None), (5, ""), (6, "\n\t"), (7, LONG), (8, LONG), (9, "short"), (10, "short"), (11, BASE[:60] + "and then something else"), (12, "É" * 80),
    (13, "x" + "É" * 80), (None, BASE), (None, None), (14, "line one of the text here\nLINE ONE OF THE TEXT HERE \nother"), (15, "line one of the text here\nmine"), (16, " line one of the text here\t\nx\n"), (1, BASE), (9, "other"),
]
SCHEMA = "doc_id long, text string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def clash(df):
    """The same rows with columns whose names an operator might use."""
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("n_lines", "n_dropped", "n_bytes", "kept", "hash", "key", "id", "h", "fp", "root", "runs", "mark", "t"))))


def test_exact_groups(spark):
    got = sorted((tuple(r) for r in exact_groups(clash(frame(spark))).collect()), key=str)
    groups: dict = {}
    for d, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for d, t in ROWS:
        norm = re.sub(r"[\x20\x09-\x0D]+", "", t or "")
        keep = min(groups[norm], key=lambda x: x[:3])[3]
        want.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert exact_groups(frame(spark, [])).count() == 0
    small = exact_groups(frame(spark), max_bytes=1)  # a full filter loses nothing
    assert sorted((tuple(r) for r in small.collect()), key=str) == sorted(want, key=str)


def test_exact_dedup_keeps_one_row_per_text(spark):
    kept = exact_dedup(clash(frame(spark)))
    assert kept.columns == clash(frame(spark)).columns
    rows = kept.collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", r["text"] or "") for r in rows]
    assert len(set(norm)) == len(norm) == len({re.sub(r"[\x20\x09-\x0D]+", "", t or "") for _, t in ROWS})
    assert {r["doc_id"] for r in rows} >= {3, 7, 6} and 2 not in {r["doc_id"] for r in rows}
    assert exact_dedup(frame(spark, [])).count() == 0


def brute_lines(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held: dict = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or len(held.get(key(x), ())) < docs or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [*ROWS, *((20 + i, "É" * 19 + f"é\n{'é' * 19}\nown {i}") for i in range(4))]
    for size in (32 << 20, 1):
        got = line_dedup(clash(frame(spark, rows)), max_bytes=size).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert line_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        line_dedup(frame(spark), min_docs=1)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAÉ \n\t\x0b\xa0", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def brute_components(rows):
    fps = [(d, brute_fingerprint(t or "")) for d, t in rows]
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                part[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(fps)), key=str)


def near_rows(n=80, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 60)) for _ in range(120)]
        for _ in range(rng.randint(1, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append((1000 + len(out), " ".join(copy)))
    rng.shuffle(out)
    return out


def test_simhash_components(spark):
    rows = [*ROWS, *near_rows()]
    got = simhash_groups(clash(frame(spark, rows))).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert simhash_groups(frame(spark, [])).count() == 0
    kept = near_dedup(clash(frame(spark, rows)))
    groups = {c for _, _, c in brute_components(rows)}
    assert kept.columns == clash(frame(spark)).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)


def test_simhash_of_a_crowd(spark):
    """Fingerprints of one bucket, more than are compared in place."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    rows = [(i, " ".join([*words[:i], f"new{i}", *words[i:]])) for i in range(600)]
    assert {r["component_id"] for r in simhash_groups(frame(spark, rows)).collect()} == {c for _, _, c in brute_components(rows)}


def brute_spans(rows, length=50):
    first: dict = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1 if d is not None else 0):
            first[raw[i : i + length]] = min(d, first.get(raw[i : i + length], d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1 if d is not None else 0):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd, filter_bytes", [(1000, 32 << 20), (2, 32 << 20), (1000, 1100), (1000, 700), (1000, 1)])  # one pass, one with fewer bits, some, none with a filter
def test_suffix_array_dedup(spark, monkeypatch, crowd, filter_bytes):
    passes = []
    monkeypatch.setattr(suffix_dedup, "_runs_of", lambda docs, suspects, *rest, own=suffix_dedup._runs_of: passes.append(suspects) or own(docs, suspects, *rest))
    monkeypatch.setattr(bloom, "LEAST_BITS", 1 << 10)
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh é", k=300))
    rows = [r for r in ROWS if r[1] != LONG]
    rows += [(100 + i, "".join(rng.choices("xyz ", k=40)) + passage[rng.randint(0, 100) : rng.randint(150, 300)] + "".join(rng.choices("xyz ", k=40))) for i in range(40)]
    rows += [(200 + i, "ab" * rng.randint(0, 150)) for i in range(8)] + [(300, "a" * 70_000), (301, "a" * 120)]
    got = suffix_array_dedup(clash(frame(spark, rows)), crowd=crowd, filter_bytes=filter_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_spans(rows)
    assert passes == [None] if filter_bytes == 1 else len(passes) == 1 or filter_bytes == 700
    assert filter_bytes != 700 or 1 < len(passes) < 9


def test_suffix_array_dedup_edges(spark):
    assert suffix_array_dedup(frame(spark, [])).count() == 0
    out = {r["doc_id"]: r for r in suffix_array_dedup(clash(frame(spark, [(1, "É" * 60), (2, "x" + "É" * 60 + "y"), (3, None)]))).collect()}
    assert out[2]["text"] == "xy" and out[2]["n_removed"] == 120 and out[3]["text"] == "" and out[1]["text"] == "É" * 60


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6))
def test_suffix_order(parts):
    text, stops = b"\0", [0]
    for part in parts:
        text += part + b"\0"
        stops.append(len(text) - 1)
    order = suffix_order(text, stops)
    assert sorted(order) == [i for i in range(len(text)) if text[i]]
    keys = [text[i : text.index(0, i)] for i in order]
    assert keys == sorted(keys)


def test_suffix_order_is_linear():
    began, n = time.process_time(), 1 << 17
    order = suffix_order(b"\0" + b"a" * n + b"b\0", [0, n + 2])
    assert order == [*range(1, n + 1), n + 1] and time.process_time() - began < 5


def test_colliding_contexts_are_seen():
    row = lambda part, doc: {"h": 1, "c": 2, "n": 1, "p": 0, "part": part, "low": doc, "high": doc}
    with pytest.raises(ValueError):
        list(_sorter(50, 28)([pd.DataFrame([row(b"x" * 50, 1), row(b"y" * 50, 2)])]))


def test_filters_in_passes(spark):
    """Each repeat is suspected in one pass, and few others are, however small the filters: first they have fewer bits, then there are more."""
    df = spark.range(60_000).select(F.xxhash64(F.col("id") % 50_000).alias("h"))
    hashes, where = np.array([r["h"] for r in df.collect()]), layout(60_000)
    payload = df.mapInPandas(lambda frames: sent((f["h"].to_numpy() for f in frames), where), SENT_SCHEMA)
    for size, passes, most in ((32 << 20, 1, 22_000), (6_000, 1, 30_000), (2_000, 3, 30_000)):
        filters = list(repeat_filters(payload, where, size, 8))
        held = [x.suspects(hashes) for x in filters]
        assert len(filters) == passes and sum(x.held.value.nbytes for x in filters) < 15_000
        total = np.sum(held, axis=0)
        assert total.max() == 1 and total[:10_000].all() and total[50_000:].all() and total.sum() < most
    assert list(repeat_filters(payload, where, 1, 8)) == [None]


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=50, max_size=400))
def test_equal_windows_have_equal_anchors(raw):
    first, many, place, hashes, _ = anchors(raw + raw)
    assert many.sum() == len(raw + raw) - 49
    by_window: dict = {}
    for q, n, p, h in zip(first.tolist(), many.tolist(), place.tolist(), hashes.tolist()):
        for w in range(q, q + n):
            assert by_window.setdefault((raw + raw)[w : w + 50], (p - w, h)) == (p - w, h)


def test_filter_never_misses(spark):
    df = spark.range(3000).withColumn("h", F.xxhash64(F.col("id") % 2900))
    for size in (32 << 20, 1):
        again = df.where(column_filter(df, "h", 3000, size).holds(F.col("h")))
        assert set(range(100)) <= {r["id"] for r in again.collect()}
        held = column_filter(df, "h", 3000, size, members=True)
        assert df.where(held.holds(F.col("h"))).count() == 3000
