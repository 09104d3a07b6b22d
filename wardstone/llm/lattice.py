"""The lattice of a word's segmentations into the pieces of an existing subword vocabulary.

A word is a marker of its leading space and its characters. No piece that is used here has the marker anywhere but at
its start, so a text's lattice is the chain of its words' lattices. A character without a piece of its own (and a
literal marker) is spelled by the vocabulary's byte pieces, so every text has a segmentation.
"""

from __future__ import annotations

import math
from array import array
from functools import lru_cache

import public_tokenizers
import sentencepiece

MARKER = "▁"
#: Scores below this belong to pieces that are no part of the vocabulary's order.
LEAST_SCORE = -1e6


class Vocabulary:
    """Pieces of a SentencePiece model file: ids by piece, ids of byte pieces, and a log weight for each id.

    A score is the negative rank of a piece; its weight follows Zipf's law, 1 / (rank + 2).
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.piece = [model.id_to_piece(i) for i in range(self.size)]
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.weight = [-math.inf] * self.size
        ranks = 0.0
        for i, piece in enumerate(self.piece):
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > LEAST_SCORE and MARKER not in piece[1:]:
                self.ids[piece] = i
                self.weight[i] = -math.log(2 - model.get_score(i))
                ranks = max(ranks, -model.get_score(i))
        self.ids[MARKER] = model.piece_to_id(MARKER)  # the lone marker and the bytes weigh as little as the last piece
        for i in (self.ids[MARKER], *self.bytes.values()):
            self.weight[i] = -math.log(2 + ranks)
        total = math.log(sum(map(math.exp, self.weight)))
        self.weight = [w - total for w in self.weight]
        self.whole = frozenset(self.ids.values())  # pieces that are no bytes
        self.longest = max(map(len, self.ids))
        self.value = {i: b for b, i in self.bytes.items()}
        self.octets = {i: piece.replace(MARKER, " ").encode() for piece, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}

    def ending(self, word: str, j: int) -> list[tuple[int, tuple[int, ...]]]:
        """(start, ids) of the pieces that end at ``j`` in ``word`` (the marker, then characters), by their starts."""
        out, ids = [], self.ids
        for i in range(max(0, j - self.longest), j):
            piece = ids.get(word[i:j])
            if piece is not None and not (i and word[i] == MARKER):
                out.append((i, (piece,)))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, tuple(self.bytes[b] for b in word[j - 1].encode("utf-8", "surrogatepass"))))
        return out

    def decode(self, ids) -> str:
        """The text of a segmentation; the leading space of the first word was not in the text."""
        return b"".join(map(self.octets.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))


def forward(vocab: Vocabulary, word: str, weight) -> array:
    """Log of the summed weight of all segmentations of each prefix of a marked word, in log space; memory is 8 bytes a character."""
    total, exp, log = array("d", [0.0]), math.exp, math.log
    for j in range(1, len(word) + 1):
        parts = [total[i] + (weight[ids[0]] if len(ids) == 1 else sum([weight[x] for x in ids])) for i, ids in vocab.ending(word, j)]
        if len(parts) == 1:
            total.append(parts[0])
        else:
            most = max(parts)
            total.append(most + log(sum([exp(x - most) for x in parts])))
    return total
