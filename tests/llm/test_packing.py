import random
import re
from collections import Counter

import pytest

from sigloom.llm import packing
from sigloom.llm.packing import Packing, encoding, pack, place, tokens, vocabulary

from .common import clashing, docs, odd_rows, prose


def brute(lengths, sequence):
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= sequence]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return packs


@pytest.mark.parametrize("seed", range(40))
def test_histogram_steps_equal_piece_by_piece(seed):
    rng = random.Random(seed)
    sequence = rng.choice([10, 17, 64])
    lengths = [rng.randint(1, sequence) for _ in range(rng.randint(0, 60))]
    got = place(Counter(lengths), sequence)
    assert sorted(n for k, p in got for n in p * k) == sorted(lengths)
    assert Counter(sum(p) for k, p in got for _ in range(k)) == Counter(map(sum, brute(lengths, sequence)))


def check(spark, rows, how):
    got = pack(clashing(docs(spark, rows)), how).collect()
    encode = encoding(vocabulary(how))
    expected = Counter()
    for d, t, *_ in rows:
        x = [*(tokens(encode, t).tolist() if t and len(t) > 100_000 else encode.encode_ordinary(t)), encode.n_vocab] if t else []
        expected.update((d, s, tuple(x[s : s + how.sequence])) for s in range(0, len(x), how.sequence))
    assert Counter((r.doc_id, r.start, tuple(r.tokens)) for r in got) == expected and all(len(r.tokens) == r.length for r in got)
    by = {}
    for r in got:
        by.setdefault(r.pack_id, []).append((r.offset, r.length))
    assert set(by) == set(range(len(by)))
    for members in by.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= how.sequence
    assert Counter(sum(n for _, n in m) for m in by.values()) == Counter(map(sum, brute([r.length for r in got], how.sequence)))
    return got


def test_every_token_has_its_place(spark):
    rng = random.Random(4)
    for limit in (10**6, 0):
        check(spark, [(i, prose(rng, rng.randint(1, 120))) for i in range(120)], Packing(sequence=64, broadcast_counts=limit))


def test_odd_rows(spark):
    got = check(spark, odd_rows(), Packing(sequence=256))
    assert not {1, 2} & {r.doc_id for r in got} and sum(r.doc_id == 6 for r in got) == 2
    assert pack(docs(spark, [])).count() == 0 and pack(docs(spark, [(1, None), (2, "")])).count() == 0


def test_runs_of_white_space_are_encoded_as_the_pattern_has_them(monkeypatch):
    encode, rng = encoding(vocabulary(Packing())), random.Random(6)
    texts = ["".join(rng.choice([" ", "\n", "\t", "  ", " " * 9, "a", "b1", "!", "é", "\x1c", "it's "]) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    expected = [encode.encode_ordinary(t) for t in texts]
    for run in (2, 5):
        monkeypatch.setattr(packing, "_LONG_SPACE", re.compile(packing._LONG_SPACE.pattern.replace("16384", str(run))))
        monkeypatch.setattr(packing, "_APART", 0)
        monkeypatch.setattr(packing, "_PART", 9)
        assert [tokens(encode, t).tolist() for t in texts] == expected


def test_long_runs_do_not_break_the_engine():
    encode = encoding(vocabulary(Packing()))
    for text in (" " * 1_200_000 + "x", "\n" * 1_200_000, "a \n" * 400_000):
        assert encode.decode(tokens(encode, text).tolist()) == text
