"""Texts with runs of white space on which the encoder's pattern used to overflow its stack."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardstone.llm.packing import Encoder

N = 1_100_000


@pytest.mark.parametrize("text", [
    " " * N, "\n" * N, "a b" + " " * N + "c d", "a\n" + "\n" * N + "b", " x" + "\t\r\n \x0b　\xa0" * (N // 7) + "y  z", "a" + " \n" * (N // 2) + "<|endoftext|>" + "\n" * N + " b",
    "a" + "\x1c" * 20_000 + " " * 20_000 + "\x85" + "b" + " " * 9_999 + "\n" * 10_001 + "'s" + "​" * 10_000, "x" * 20_000 + " " * 10_000 + "1" + "\n" * 9_999 + ".",
])
def test_long_white_space(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.frombuffer(Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_mixed_texts():
    rng, tokenizer = random.Random(7), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = ["the", "don't", "I'LL", "été", "漢字仮名", "😀👍🏽", "x=1;", "3.14", "--", "\t", "\n\n", "  ", "\r\n", "\u00a0", "a\u0301", "\u200b", "Ω≈ç", "http://a.b/c?d=e", "0" * 40, "ſ'ſ", "\x00", "\ufffd"]
    for size in (3_000, 30_000, 120_000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "\n"]) for _ in range(size // 3))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
