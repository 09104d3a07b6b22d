"""The prefix trie and the repair of conversations, against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import pytest
from pyspark.sql import functions as F

from wardstone.llm.conversation_repair import Repairs, repair_conversations
from wardstone.llm.conversation_trie import conversation_trie
from wardstone.llm.ordered import dense_names, ordered_sha256, running

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def frame(spark, rows, parts=6):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.select("*", *(F.lit(i).alias(x) for i, x in enumerate(("c", "d", "path", "k", "n", "p", "depth", "cost", "audit", "name", "role2"))))


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def corpus(seed, n=60, texts=4, long=0):
    rng, rows = random.Random(seed), []
    words = ["Yes.", "No", "", " \t", "Why? ", "über…", "ok!", None][:texts] if texts < 8 else ["Yes.", "No", "", " \t", "Why? ", "über…", "ok!", None]
    for c in range(-7, n):
        if rng.random() < 0.15:
            continue
        size = rng.choice([0, 1, 2, 3, 5, 8, 13]) if c != long else 150
        for t in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.5 else ("user", "assistant")[t % 2]
            rows.append((c, rng.choice([t, t, t, t, None, 3]), role, rng.choice(words)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


# --- ordered helpers --------------------------------------------------------------------------------------------------


def test_running_sums_and_digests_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(-5, 9), rng.choice(["", "ab", "é" * 9])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, i long, v long, s string").repartition(7)
    want, total, texts = [], defaultdict(int), defaultdict(list)
    for k, i, v, s in rows:
        total[k] += v
        texts[k].append(s)
        want.append((i, total[k]))
    assert taken(running(df, "k", ["i"], total="v").select("i", "total")) == sorted(want)
    digests = {k: hashlib.sha256("|".join(x).encode()).hexdigest() for k, x in texts.items()}
    for chunk in (10, 1 << 20):
        assert dict(ordered_sha256(df, ["k"], ["i"], "s", b"|", chunk).collect()) == digests
    names = dict(((r.k, r.s), r.name) for r in dense_names(df, ["k", "s"]).collect())
    assert sorted(names.values()) == list(range(len({(r[0], r[3]) for r in rows})))


# --- trie -------------------------------------------------------------------------------------------------------------


def trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in own if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((own[0], len(node), parent, len(own), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed, texts", [(1, 3), (2, 8)])
def test_trie_equals_brute_force(spark, seed, texts):
    rows = corpus(seed, texts=texts) + [(None, 1, "user", "x"), (70, 2, "user", "w" * 300_000), (71, 2, "user", "w" * 300_000)]
    assert taken(conversation_trie(frame(spark, rows))) == trie(rows)


def test_trie_of_like_and_empty_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(100) for t in range(c % 3 + 1)]
    assert taken(conversation_trie(frame(spark, rows))) == trie(rows)
    assert taken(conversation_trie(frame(spark, [(None, 1, "user", "x")]))) == []
    assert taken(conversation_trie(spark.createDataFrame([], SCHEMA))) == []


# --- repair -----------------------------------------------------------------------------------------------------------


def damage(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 1:
            x = ""
        if k == 2:
            x = "".join(ch for ch in x if ch not in ".!?")
        if k == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for r, x in rows:
        rest = x.rstrip(SPACE)
        out.append("blank" if not rest else "duplicate" if (r, x) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, marks, costs):
    """(cost, edits, repaired rows) over all ways, by recursion over rows and states of the pattern."""
    rerole, delete, insert, cut = costs
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, room):
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if room:
            for x in follow[last].replace("s", ""):
                c, e, out = best(i, x, room - 1)
                ways.append((c + insert, "I" + e, ({"u": "user", "a": "assistant"}[x] + ":",) + out))
        if i < len(rows):
            role, text = rows[i]
            c, e, out = best(i + 1, last, 2)
            ways.append((c + delete, "D" + e, out))
            if marks[i] not in ("blank", "duplicate"):
                stays = cut if marks[i] == "truncated" else 0
                if role[:1] and role[:1] in follow[last]:
                    c, e, out = best(i + 1, role[:1], 2)
                    ways.append((c + stays, "K" + e, (f"{role}:{text}",) + out))
                for x in follow[last].replace("s", ""):
                    c, e, out = best(i + 1, x, 2)
                    ways.append((c + stays + rerole, "R" + e, ({"u": "user", "a": "assistant"}[x] + ":" + text,) + out))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), 0, -1):  # from the end, so that recursion stays shallow
        for last in follow:
            best(i, last, 2)
    return best(0, "", 2)


def repair(rows, plant, costs=(1, 2, 5, 5)):
    held = defaultdict(list)
    for c, t, r, x in damage(rows) if plant else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        held[c].append((t is not None, t or 0, r, x))
    out = []
    for c in {r[0] for r in rows}:
        own = sorted(held[c])
        turns = [t for known, t, *_ in own if known]
        pairs = [(r, x) for *_, r, x in own]
        marks = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, edits, lines = cheapest(tuple(pairs), tuple(marks), costs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("seed, plant, costs", [(3, True, (1, 2, 5, 5)), (4, False, (3, 4, 1, 2)), (5, False, (1, 2, 5, 5))])
def test_repair_equals_brute_force(spark, seed, plant, costs):
    rows = corpus(seed, n=90, texts=8) + [(None, 1, "user", "x"), (None, 4, "assistant", "y."), (200, 2, "user", "w" * 300_000 + "."), (200, 9, "assistant", "w" * 300_000 + "?"), (201, 0, None, None), (202, 0, "", "")]
    assert taken(repair_conversations(frame(spark, rows), plant=plant, costs=costs)) == repair(rows, plant, costs)


def test_repair_of_one_large_conversation_and_of_none(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["Fine.", "cut", "", f"own {t}."])) for t in range(400)] + [(1, 500, "user", "again.")] * 50
    assert taken(repair_conversations(frame(spark, rows))) == repair(rows, False)
    assert taken(repair_conversations(spark.createDataFrame([], SCHEMA), plant=True)) == []


def test_edits_of_all_short_conversations():
    table = Repairs((1, 2, 5, 5))
    for n in range(4):
        for rows in product([("s", "x."), ("u", "x."), ("a", "x."), ("u", "x"), ("t", "x."), ("a", "")], repeat=n):
            marks = ["blank" if not x else "" if x[-1] == "." else "truncated" for _, x in rows]
            symbols = [3 * "sua".find(r) % 12 + {"": 0, "truncated": 1, "blank": 2}[m] if r != "t" else 9 for (r, _), m in zip(rows, marks)]
            after, first, cost = table.scan(table.end, symbols, [1] * n)
            letters, _, q = table.trace(after, symbols, [1] * n, 0)
            want = cheapest(rows, tuple(marks), (1, 2, 5, 5))
            assert (cost + table.vectors[first][0], letters + "I" * len(table.trailing(q))) == want[:2]
