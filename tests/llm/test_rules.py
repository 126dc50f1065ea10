import math
import random
from fractions import Fraction

from sigloom.llm.rules import CUTOFFS, Risk, apply, at_most, statistics, thresholds

from .common import clashing, docs, odd_rows, prose


def test_binomial_tail_is_exact():
    for n in (1, 7, 60, 300):
        for p in (Fraction(1, 100), Fraction(1, 5)):
            for k in range(0, n + 1, max(1, n // 9)):
                exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert math.isclose(at_most(k, n, float(p)), float(exact), rel_tol=1e-9)


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_certified_cutoffs_and_decisions(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30) + (" ###" * 40 if i % 10 == 0 else ""), "en") for i in range(2000)] + [(5000 + i, prose(rng, 30), "de") for i in range(20)]
    labels = [(i, int(i % 10 != 0)) for i in range(2000)] + [(5000 + i, 1) for i in range(20)]
    frame = clashing(docs(spark, rows))
    found = {(r.stratum, r.rule): r for r in thresholds(statistics(frame), labels_table(spark, labels)).collect()}
    assert len(found) == 2 * len(CUTOFFS) and all(r.cutoff is None for (s, _), r in found.items() if s == "de")
    for (s, _), r in found.items():
        if r.cutoff is not None:
            assert at_most(r.lost, r.n, 0.05 / 6) <= 0.05 / 12
    assert found["en", "symbols"].cutoff == 20
    got = apply(frame, labels_table(spark, labels)).collect()
    lost = [r for r in got if not r.keep]
    assert {r.doc_id for r in lost} >= {i for i in range(0, 2000, 10)} and sum(r.doc_id % 10 != 0 for r in lost) <= 0.05 * 1800


def test_statistics(spark):
    (r,) = statistics(docs(spark, [(1, "!!AB cd cd\nxx\nxx", None)])).collect()
    assert (r.stratum, r.letters, r.symbols, r.capitals, r.repeats, r.lines, r.width) == ("none", 10, 125, 200, 400, 333, 20)


def test_odd_rows_and_empty_tables(spark):
    frame = docs(spark, odd_rows())
    got = apply(clashing(frame), labels_table(spark, [(6, 1), (None, 1), (7, None)]), Risk()).collect()
    assert len(got) == len(odd_rows()) and all(r.keep and (r.blank == 0) == (r.letters > 0) for r in got)
    assert apply(docs(spark, []), labels_table(spark, [])).count() == 0
    assert apply(frame, labels_table(spark, [])).count() == len(odd_rows())


def test_a_text_without_a_letter_is_rejected_only_under_the_guarantee(spark):
    rows = [(i, prose(random.Random(i), 30), "en") for i in range(2000)] + [(9000, "123 456", "en"), (9001, "123", "de")]
    got = {r.doc_id: r.keep for r in apply(docs(spark, rows), labels_table(spark, [(i, 1) for i in range(2000)])).collect()}
    assert not got[9000] and got[9001]
    blanks = [(i, "12" if i % 4 == 0 else t, "en") for i, t, _ in rows[:2000]]
    assert all(r.keep or r.letters for r in apply(docs(spark, blanks), labels_table(spark, [(i, 1) for i in range(2000)])).collect())
