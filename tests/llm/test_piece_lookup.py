"""Pieces are looked up once for each string; only those that meet another piece's place look further."""

import random

import numpy as np

from wardstone.llm.lattice import forward, vocabulary
from wardstone.llm.lattice_batch import PieceTable, expected_counts, log_marginals
from wardstone.llm.piece_sampling import SHARPNESS, Sampler


class Counted(np.ndarray):
    seen = 0

    def __getitem__(self, at):
        Counted.seen += np.size(at)
        return super().__getitem__(at).view(np.ndarray)


def test_one_look_a_string():
    table, vocab = PieceTable(None), vocabulary()
    rng, pieces = random.Random(3), list(vocab.ids)
    strings = [rng.choice(pieces) if i % 2 else "".join(rng.choice("abcdefgé漢") for _ in range(5)) for i in range(4000)]
    hashes = np.zeros((40, 100), np.uint64)
    for i, s in enumerate(strings):
        h = np.zeros(1, np.uint64)
        for c in s:
            h = table.more(h, np.array([ord(c)], np.uint64))
        hashes[i // 100, i % 100] = h[0]
    table.keys = table.keys.view(Counted)
    Counted.seen = 0
    got = table.ids(hashes)
    assert got.ravel().tolist() == [vocab.ids.get(s, -1) for s in strings]
    assert Counted.seen < 1.2 * len(strings)


def test_drawn_pieces_spell_the_text():
    texts = ["the quick brown fox", "▁ marked▁ words", "漢字 \U0001f600 a\x00b", "x" * 40 + " y", "", " ", "  two  spaces "]
    for text, pieces in zip(texts, Sampler(None, SHARPNESS)(texts, list(range(len(texts))))):
        assert vocabulary().decode(pieces.tolist()) == text


def test_few_looks_a_word():
    """What starts no piece is not looked up: of the 16 lengths at each character few are left."""
    table, words = PieceTable(None), ["internationalisation"[i:] + "qzj" * 4 for i in range(10)]
    codes = np.array([[ord(c) for c in w[:20]] for w in words], np.uint64).T.copy()
    found = {(k, int(x)) for k, at, _ in table.edges(codes) for x in at}
    want = {(k, i * len(words) + j) for j, w in enumerate(words) for i in range(20) for k in range(1, 21 - i) if w[i : i + k] in vocabulary().ids}
    table.keys = table.keys.view(Counted)
    Counted.seen = 0
    list(table.edges(codes))
    assert found == want and Counted.seen < 5 * codes.size


def test_sums_near_the_least_number():
    """Words whose weight no double holds are summed in log space, the others of their matrix too."""
    vocab, words = vocabulary(), ["\U00020000" * 30, "a" * 30, "\u4e00\U00020000" * 15, "plain"]
    weight = np.array(vocab.weight)
    want = [forward(vocab, "\u2581" + w, weight.tolist())[-1] for w in words]
    assert min(want) < -745 and np.allclose(log_marginals(words, weight), want, rtol=1e-9)
    both, each = expected_counts(words, weight), sum(expected_counts([w], weight) for w in words)
    assert np.allclose(both, each) and np.isfinite(both).all()
