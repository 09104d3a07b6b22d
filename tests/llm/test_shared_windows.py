"""Only windows that may have an equal are sorted, and what tasks send to the filters follows the rows."""

import random

import numpy as np

from wardstone.llm import suffix_dedup
from wardstone.llm.bloom import FLUSH, layout, sent


def _expected(contexts, length):
    """Least document of each window's equals, by comparing bytes, for windows that an earlier document holds."""
    least = {}
    for _, _, n, _, part, low, _, bucket in contexts:
        for i in range(n):
            key = bucket, part[i : i + length]
            least[key] = min(least.get(key, low), low)
    return {(h, c, i): least[bucket, part[i : i + length]] for h, c, n, _, part, _, high, bucket in contexts for i in range(n) if least[bucket, part[i : i + length]] < high}


def test_windows_without_an_equal_are_not_sorted(monkeypatch):
    rng = random.Random(5)
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    contexts, shared = [], 0
    for bucket in range(6):
        anchor, left, right = letters(28), letters(30), letters(30)
        for i in range(12):  # every third one shares six windows of its bucket
            part = left[-10:] + anchor + right[:17] if i % 3 == 0 else letters(22) + anchor + letters(22)
            p = 10 if i % 3 == 0 else 22
            contexts.append((bucket, i, len(part) - 49, p, part, i, i if i % 2 else i + 1, bucket))
            shared += len(part) if i % 3 == 0 else 0
    sizes = []
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda text, stops, run=suffix_dedup.suffix_order: sizes.append(len(text)) or run(text, stops))
    rows = suffix_dedup._window_owners(contexts, 50, 28)
    got = {(h, c, i): m for h, c, a, b, m in rows.itertuples(index=False) for i in range(a, b + 1)}
    assert got == _expected(contexts, 50)
    assert sum(sizes) < shared  # the anchors stand as one byte, and equal runs are sorted once


def test_nothing_shared_is_not_sorted(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda text, stops: 1 / 0)
    contexts = [(1, 1, 1, 5, b"abcde" + b"x" * 28 + b"f" * 17, 3, 9, 0), (1, 2, 1, 5, b"abcdf" + b"x" * 28 + b"f" * 17, 4, 4, 0)]
    rows = suffix_dedup._window_owners(contexts, 50, 28)
    assert rows.values.tolist() == [[1, 1, 0, 0, 3]]


def test_rows_sent_do_not_grow_with_the_number_of_segments():
    """Five times the hashes are sent in five times the rows, not in 20 times as many."""
    rng, rows = np.random.default_rng(1), []
    for hashes in (8_500_000, 42_500_000):  # 0.1 and 0.5 GB of text in op3
        one = sum(map(len, sent([rng.integers(-(1 << 63), (1 << 63) - 1, FLUSH)], layout(hashes))))
        rows.append(one * hashes / FLUSH)
    assert rows[1] <= 5.1 * rows[0]
    assert layout(2_500_000_000).segments * layout(2_500_000_000).bits >= 12 * 2_500_000_000  # 30 GB keep their bits
