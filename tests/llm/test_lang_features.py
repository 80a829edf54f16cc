"""The remembered features and words of op4 against their plain definitions."""

from __future__ import annotations

import zlib

import numpy as np

from quire.llm import crf_lang

WORDS = ["x", "ab", "abc", "pab", "papab", "sasas", "żółć", "a" * 64, "naïve", "word"]


def plain(word, lexicon, buckets):
    edged = f"<{word}>"
    found = {f"p{word[:k]}" for k in (1, 2, 3, 4)} | {f"s{word[-k:]}" for k in (1, 2, 3, 4)}
    found |= {edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1)} | ({f"w{word}"} if word in lexicon else set())
    return sorted(zlib.crc32(x.encode()) % buckets for x in found)


def test_features_are_remembered(monkeypatch):
    for most in (crf_lang.FEATURES, 5):
        monkeypatch.setattr(crf_lang, "FEATURES", most)
        known = crf_lang.Buckets(1000)
        for word in WORDS * 2:
            assert sorted(crf_lang.features(word, frozenset(["word"]), known)) == plain(word, {"word"}, 1000)
        assert 0 < len(known) <= most
    flat, lengths = crf_lang.flattened([[1, 2], [3], [4, 5, 6]])
    assert flat.tolist() == [1, 2, 3, 4, 5, 6] and lengths.tolist() == [2, 1, 3]


def test_scores_of_words():
    model = crf_lang.fit([("one word here", "en"), ("ein wort hier", "de")], crf_lang.Settings(rounds=2))
    want = [model.weights[crf_lang.features(w, model.lexicon, len(model.weights))].sum(axis=0) for w in WORDS]
    assert np.allclose(model.word_scores(WORDS), want, atol=1e-5)


def test_words_of_ascii_texts():
    for text in ("", None, "Some Words 12ab_c", "İstanbul K ſ ABC", "a" * 200, "été x1y2", "́a b"):
        assert crf_lang.words_of(text) == crf_lang.WORD.findall((text or "").lower())
