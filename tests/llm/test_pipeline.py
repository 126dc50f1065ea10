"""The pipeline's stages one by one against their operators' brute-force results, on planted cases."""

import random

import pytest

import __spark_entry__
import corpus_pipeline
from sigloom.llm.packing import Packing, encoding, tokens, vocabulary

from .common import clashing, docs, odd_rows, prose, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    clean = [(100 + i, prose(rng, rng.randint(20, 90)), "en", "s", 0) for i in range(60)]
    near = clean[3][1].split()
    near[5] = words(rng, 1)[0]
    bench = prose(rng, 40)
    rows = clean + [(200, clean[3][1], "en", "s", 0), (201, " ".join(near), "en", "s", 0), (202, prose(rng, 9) + " " + bench + " " + prose(rng, 9), "en", "s", 0), (203, prose(rng, 30) + " me@mail.example.com " + prose(rng, 30), "en", "s", 0)]
    rows += [(300 + i, "Привет мир это текст", None, "s", 0) for i in range(2)] + odd_rows()
    d = str(tmp_path_factory.mktemp("tables"))
    docs(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, clean


def test_stages_take_effect(spark, folder):
    d, rows, clean = folder
    now = spark.read.parquet(f"{d}/documents.parquet")
    seen = [[r.doc_id for r in now.collect()]]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, d), name)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([r.doc_id for r in now.collect()])
    language, near, decontaminated, pii = seen[1:]
    assert not {300, 301, 1, 2, 3, 5} & set(language) and {200, 201, 202, 203, 7} <= set(language)
    assert sum(i in near for i in (103, 200, 201)) == 1 and 103 in near and near.count(6) == 1
    assert set(near) - set(decontaminated) == {202} and sorted(map(str, pii)) == sorted(map(str, decontaminated))
    assert {c[0] for c in clean} <= set(pii)
    assert not any("@mail" in r.text for r in now.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, d).collect()
    encode = encoding(vocabulary(Packing()))
    assert sum(r.length for r in packed) == sum(len(tokens(encode, r.text)) + 1 for r in now.collect())
    flat = lambda rows: {(*r[:4], *r.tokens) for r in rows}
    again = corpus_pipeline.run(spark, d).collect()
    assert flat(again) == flat(packed)  # in which pack of equal content a piece comes is a matter of the files' order
    filled = lambda rows: sorted(sum(r.length for r in rows if r.pack_id == k) for k in {r.pack_id for r in rows})
    assert filled(again) == filled(packed)


def test_every_stage_with_odd_rows_more_columns_and_no_rows(spark, folder):
    d, rows, _ = folder
    for more in (odd_rows(), rows[:2] * 3 + [(None, rows[0][1], "en", "s", 0)], []):
        now = clashing(docs(spark, more))
        columns = now.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(stage(spark, now, d), name)
            assert now.columns == columns
        if more and more[0][1] == rows[0][1]:  # one copy each of two texts, ties by the least id
            assert sorted(r.doc_id for r in now.collect()) == [100, 101]
        assert corpus_pipeline.STAGES[-1][1](spark, now, d).count() >= now.count() and (more or not now.count())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
