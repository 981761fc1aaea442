"""Ids of words that a worker knows already."""

import random

import numpy as np
import pytest

from weftline.llm.packing import Tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_known_words_are_not_encoded_again(monkeypatch):
    tokens, learnt = Tokens(public_tokenizers.path("word_bpe_49k.json")), []
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda hashes, words: learnt.append(len(words)) or learn(hashes, words))
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéäßøþœĳ"
    words = sorted({"".join(rng.choices(letters, k=rng.randrange(4, 11))) for _ in range(60_000)})
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    first = tokens.encode(texts)
    again = tokens.encode([t.upper() if "ß" not in t and "ĳ" not in t else t for t in texts])
    assert sum(learnt) == len(words)
    for t, a, b in zip(texts, first, again):
        assert np.array_equal(a, b) and list(a) == tokens.tok.encode(t, add_special_tokens=False).ids


def test_ids_of_mixed_texts_are_the_tokenizers():
    tokens, rng = Tokens(public_tokenizers.path("word_bpe_49k.json")), random.Random(4)
    parts = ["It's", "we'LL", "'tis", "x²", "½", "1234", "Éa", "ÀÇ", "ß", "İ", "Σς", "é", "a b", "\u0085", "\u001c", "<|endoftext|>", "<|", "…", "!?", "|", "日本", "🙂", "\n\n", "\t", "ŉ", "ǅ", "''s", "µ", "ª"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(600)]
    for t, ids in zip(texts, tokens.encode(texts)):
        assert list(ids) == tokens.tok.encode(t, add_special_tokens=False).ids
    assert tokens.one is not None
