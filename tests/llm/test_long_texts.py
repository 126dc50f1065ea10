"""A text that is read in parts gives what it gives as one block."""

import random

import numpy as np
import pytest

from sigloom.llm import decontaminate, langid, pii, quality, rules, simhash, textkernel, toxicity

LETTERS = list("aaB ,\n!é𝔘Z1") + ["the ", "\n\n"]


def texts(n=120):
    rng = random.Random(1)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(65, 300))) for _ in range(n)] + ["a" * 200, " " * 200, "\n" * 99 + "b"]


def results(text):
    words = textkernel.Hashed([text])
    counts = langid._blocks([text])[0][1:]
    return [
        words.hash, words.first, textkernel.Hashed([text], rules._in_line).hash, simhash.fingerprints([text])[0], toxicity.features(words, 22), *decontaminate.winnow(words, 3, 2),
        *counts, quality.features([text]).round(5), np.array([v for v in rules.measured([text]).values()]),
    ]


@pytest.mark.parametrize("size", [5, 16, 64])
def test_parts_equal_the_whole(monkeypatch, size):
    whole = [results(t) for t in texts()]
    monkeypatch.setattr(textkernel, "BLOCK_CHARS", size)
    monkeypatch.setattr(decontaminate, "_SLICE", 4)
    monkeypatch.setattr(toxicity, "_SLICE", 5)
    monkeypatch.setattr(simhash, "_ROWS", 8)
    for text, expected in zip(texts(), whole, strict=True):
        for a, b in zip(results(text), expected, strict=True):
            assert np.array_equal(a, b)


@pytest.mark.parametrize("sort", ["prose", "hex", "spaces", "token-"])
def test_a_long_text_is_read_in_little_memory(sort):
    """Peak of Python's and numpy's allocations, in bytes a character."""
    import tracemalloc

    n = 4_000_000
    text = {"prose": "the ring is on ", "hex": "%064x" % random.Random(1).getrandbits(256), "spaces": " \n", "token-": "token-"}[sort]
    text = (text * (n // len(text) + 1))[:n]
    for work in (lambda: simhash.fingerprints([text]), lambda: toxicity.features(textkernel.Hashed([text]), 22), lambda: langid._blocks([text]), lambda: quality.features([text]), lambda: rules.measured([text]), lambda: decontaminate.winnow(textkernel.Hashed([text]), 8, 6), lambda: pii.spans(text)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 24 * n
