"""Ids that are null or stand at more than one text: each row is judged by its own text on both paths."""

import random

from sigloom.llm.decontaminate import Winnowing, drop_contaminated, find_spans

from .common import clashing, docs, prose, words
from .test_decontaminate import benchmark

LIMITS = (10**6, 1)


def rows_and_items():
    rng = random.Random(5)
    items = [(1, prose(rng, 40)), (None, prose(rng, 40))]
    copy = [" ".join([*words(rng, 10), *text.split()[5:25], *words(rng, 10)]) for _, text in items]
    clean = [prose(rng, 50) for _ in range(4)]
    bad = [(None, copy[0]), (7, copy[1]), (8, copy[0]), (8, copy[0])]
    good = [(None, clean[0]), (None, clean[1]), (None, None), (7, clean[2]), (7, None), (7, ""), (9, clean[3]), (9, clean[3])]
    return bad, good, items


def test_both_paths_keep_the_same_rows(spark):
    bad, good, items = rows_and_items()
    frame = clashing(docs(spark, bad + good))
    for limit in LIMITS:
        kept = drop_contaminated(frame, benchmark(spark, items), Winnowing(broadcast_bytes=limit))
        assert kept.columns == frame.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(good, key=repr)


def test_both_paths_find_the_same_spans(spark):
    bad, good, items = rows_and_items()
    one, other = ([tuple(r) for r in find_spans(docs(spark, bad + good), benchmark(spark, items), Winnowing(broadcast_bytes=limit)).collect()] for limit in LIMITS)
    assert sorted(one, key=repr) == sorted(other, key=repr) and len(one) == 3


def test_two_texts_of_an_id_with_the_same_span_give_one_row(spark):
    _, _, items = rows_and_items()
    texts = [(3, items[0][1] + " one"), (3, items[0][1] + " two")]
    for limit in LIMITS:
        assert find_spans(docs(spark, texts), benchmark(spark, items[:1]), Winnowing(broadcast_bytes=limit)).count() == 1
