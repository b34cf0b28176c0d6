"""New words are encoded by the tokenizer's model, as the one piece that they are, not as texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from paperweave.llm.token_files import TOKENIZER, PieceEncoder


def test_words_are_not_encoded_as_texts(monkeypatch):
    encoder, calls, whole = PieceEncoder(public_tokenizers.path(TOKENIZER)), [], PieceEncoder.whole
    monkeypatch.setattr(PieceEncoder, "whole", lambda self, texts: calls.append(texts) or whole(self, texts))
    texts = ["plain words only\nÀ la Überfahrt", "more words\nonly"]
    got = [ids.tolist() for ids in encoder.encode(pa.array(texts))]
    assert not calls
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_against_the_tokenizer():
    random.seed(3)
    encoder = PieceEncoder(public_tokenizers.path(TOKENIZER))
    letters = [*"aabcdeTHS éÉñßÿÀ'×÷µªº\n\n 19.,!-", "the", "The ", " of", "\nAnd", "'s", "ſ", "ǅ", "中", " "]
    texts = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(1000)]
    assert all(np.array_equal(a, b) for a, b in zip(encoder.encode(pa.array(texts)), encoder.whole(texts), strict=True))
