import random

from sigloom.llm.langid import Profiles, drop_unknown, identify

from .common import clashing, docs, odd_rows, prose


def corpus(n=40):
    rng = random.Random(5)
    return [(100 + i, prose(rng, rng.randint(5, 80), lang), lang, "s", 0) for i in range(n) for lang in [("en", "de")[i % 2]]]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    new = [(1000 + i, prose(rng, 20, lang), None, "s", 0) for i in range(40) for lang in [("en", "de")[i % 2]]]
    got = {r.doc_id: r for r in identify(docs(spark, corpus() + new)).collect()}
    assert all(got[1000 + i].detected == ("en", "de")[i % 2] and got[1000 + i].keep for i in range(40))


def test_other_scripts_and_odd_rows(spark):
    rows = corpus() + odd_rows() + [(50_000, "Привет мир это текст", "en", "s", 0)]
    frame = clashing(docs(spark, [r for r in rows if r[0] != 50_000])).unionByName(clashing(docs(spark, [(50_000, "Привет мир это текст", None, "s", 0)])))
    got = {r.doc_id: r for r in identify(frame, Profiles()).collect() if r.doc_id is not None}
    assert not got[50_000].keep
    assert got[1].detected is None and not got[1].keep and not got[2].keep and not got[3].keep and not got[5].keep
    assert got[7].keep and got[7].detected == "en"
    kept = drop_unknown(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 2 and not {1, 2, 3, 5, 50_000} & set(ids)


def test_empty_tables_and_no_profiles(spark):
    assert identify(docs(spark, [])).count() == 0 and drop_unknown(docs(spark, [])).count() == 0
    (row,) = identify(docs(spark, [(1, "some text", None, "s", 0)])).collect()
    assert row.detected is None and not row.keep
