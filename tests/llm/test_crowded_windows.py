"""What op3 spends on crowded anchors and on windows with one owner does not follow how many texts hold them."""

import random

import numpy as np

from wardstone.llm import suffix_dedup
from wardstone.llm.suffix_dedup import Cutter, anchors_of

LINE = b"a line that each of many texts has, so that its anchors are crowded"


def _texts(n):
    rng = random.Random(7)
    letters = lambda size: bytes(rng.choice(b"abcdefgh") for _ in range(size))
    return [letters(30 + i % 5) + LINE + letters(30 + i % 7) for i in range(n)]


def _crowded(raws):
    h = np.concatenate([x[4] for x in anchors_of(raws)]).view(np.int64)
    hashes, counts = np.unique(h, return_counts=True)
    return hashes[counts > len(raws) // 2]


def test_crowded_windows_are_hashed_once_for_all_texts(monkeypatch):
    raws, calls = _texts(300), []
    crowded = _crowded(raws)
    assert len(crowded)
    monkeypatch.setattr(suffix_dedup, "_content_hashes", lambda *a, run=suffix_dedup._content_hashes: calls.append(len(a[0])) or run(*a))
    list(Cutter(None, crowded, 50, 28)(raws))
    assert sum(calls) <= sum(map(len, raws))  # the texts' bytes once, and not again for each text with a crowded anchor


def test_crowded_windows_are_whole_and_apart():
    for length, k in ((50, 28), (50, 14)):
        raws = _texts(40)
        h, counts = np.unique(np.concatenate([x[4] for x in anchors_of(raws, length, k)]).view(np.int64), return_counts=True)
        crowded, seen, keys, bytes_of = h[counts > 20], set(), {}, {}
        windows = {(i, a + j) for i, a, n, g in ((x[0][r], x[1][r], x[2][r], x[4].view(np.int64)[r]) for x in anchors_of(raws, length, k) for r in range(len(x[0]))) for j in range(n) if g in crowded}
        for text, h, c, first, many, offset in Cutter(None, crowded, length, k)(raws):
            for i, own, content, at, n, p in zip(*(x.tolist() for x in (text, h, c, first, many, offset))):
                assert (i, at) not in seen and 0 <= p <= length - k
                seen.update((i, at + j) for j in range(n))
                if (i, at) in windows:
                    assert n == 1
                    part = raws[i][at : at + length]
                    assert keys.setdefault(part, (own, content)) == (own, content)  # equal windows meet
                    assert bytes_of.setdefault((own, content), part) == part  # others do not
        assert len(keys) < len(windows) and windows <= seen
        assert seen == {(i, at) for i, raw in enumerate(raws) for at in range(len(raw) - length + 1)}


def test_the_only_run_of_a_bucket_is_not_sorted(monkeypatch):
    """Two contexts that share one run of windows: these have the lesser document; nothing else could equal them."""
    anchor, left, right = b"x" * 28, b"abcdefghij", b"klmnopqrstuvwxyz"
    parts = [b"1" + left + anchor + right, b"22" + left + anchor + right]
    contexts = [(1, i, len(x) - 49, x.index(anchor), x, 5 - i, 5 - i, 0) for i, x in enumerate(parts)]
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda text, stops: 1 / 0)
    rows = suffix_dedup._window_owners(contexts, 50, 28)
    assert rows.values.tolist() == [[1, 0, 1, 5, 4]]
