"""Toxicity and quality: held-out accuracy, and the odd rows."""

import math
import random

import numpy as np

from sigloom.llm import quality, textkernel, toxicity

from .common import clashing, docs, odd_rows, prose, words

INSULTS = ("idiot", "moron", "clown")


def toxic_corpus(n, at, rng):
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randint(5, 80)), i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((at + i, " ".join(w)))
        labels.append((at + i, 1, int(bad)))
    return rows, labels


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(1)
    rows, labels = toxic_corpus(900, 100, rng)
    new, truth = toxic_corpus(300, 5000, rng)
    model = toxicity.fit(clashing(docs(spark, rows)), labels_table(spark, labels + labels + [(None, 1, 1), (7, None, None)]))
    assert 0 < len(model.buckets) < 200
    got = {r.doc_id: r.toxic for r in toxicity.score(docs(spark, new), model).collect()}
    assert all(got[d] == bool(t) for d, _, t in truth)


def test_one_insult_in_a_long_text_is_seen(spark):
    rng = random.Random(2)
    rows, labels = toxic_corpus(900, 100, rng)
    model = toxicity.fit(docs(spark, rows), labels_table(spark, labels))
    long = words(rng, 5000)
    score = lambda *x: [r.toxic for r in toxicity.score(docs(spark, [(1, " ".join(x))]), model).collect()]
    assert score(*long) == [False] and score(*long[:2500], "idiot", "moron", *long[2500:]) == [True]


def plain_ftrl(rows, how):
    """FTRL-proximal as published, one coordinate at a time; {coordinate: weight}, the intercept under None."""
    z, n = {}, {}
    fit = [r for i, r in enumerate(rows) if i % 5]
    order, rng = np.arange(len(fit)), np.random.default_rng(7)

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i is None else how.l1
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((how.beta + math.sqrt(n.get(i, 0.0))) / how.alpha + how.l2)

    for epoch in range(how.epochs):
        if epoch:
            rng.shuffle(order)
        for k in order:
            x, y = fit[k]
            seen = {i: weight(i) for i in [*x.tolist(), None]}
            g = 1 / (1 + math.exp(-sum(seen.values()))) - y
            for i, w in seen.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / how.alpha * w
                n[i] = before + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_equals_plain_ftrl():
    rng, how = np.random.default_rng(3), toxicity.Ftrl(bits=10, l1=1.0)
    rows = [(np.unique(rng.integers(0, 1024, 12)), 0) for _ in range(300)]
    rows = [(np.unique(np.append(x, [5, 9])) if i % 3 == 0 else x, int(i % 3 == 0)) for i, (x, _) in enumerate(rows)]
    model, expected = toxicity.train(rows, how), plain_ftrl(rows, how)
    assert math.isclose(model.bias, expected.pop(None, 0.0), rel_tol=1e-9)
    assert model.buckets.tolist() == sorted(expected) and np.allclose(model.weights, [expected[i] for i in sorted(expected)], rtol=1e-9)


def test_scores_equal_a_sum_over_features(spark):
    rng = random.Random(6)
    rows, labels = toxic_corpus(400, 100, rng)
    model = toxicity.fit(docs(spark, rows), labels_table(spark, labels))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), model).collect()}
    for d, text in rows:
        w = textkernel.Hashed([text])
        h = [int(x) for x in w.hash]
        mixed = lambda x: int(textkernel.mix(np.array([x % 2**64], np.uint64))[0]) >> (64 - model.how.bits)
        seen = {mixed(x) for x in h} | {mixed(a * int(toxicity._PAIR) + b) for a, b in zip(h, h[1:])} | {mixed(a * int(toxicity._SKIP) + b) for a, b in zip(h, h[2:])}
        assert math.isclose(got[d], 1 / (1 + math.exp(-(model.bias + sum(weight.get(i, 0.0) for i in seen)))), rel_tol=1e-9)


def test_toxicity_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = toxic_corpus(300, 100, rng)
    model = toxicity.fit(docs(spark, rows), labels_table(spark, labels))
    got = toxicity.score(clashing(docs(spark, odd_rows())), model).collect()
    assert len(got) == len(odd_rows()) and not any(r.toxic for r in got if r.doc_id in (1, 2, 3, 5))
    assert toxicity.score(docs(spark, []), model).count() == 0
    for some in ([], [(100, 1, 0)], [(100, 1, None)]):
        (row, *_) = toxicity.score(docs(spark, rows), toxicity.fit(docs(spark, rows), labels_table(spark, some))).collect()
        assert row.score is None and not row.toxic


def quality_corpus(n, at, rng):
    rows, labels = [], []
    for i in range(n):
        w, bad = words(rng, rng.randint(15, 120)), i % 4 == 0
        if bad:
            w = [x + rng.choice(("###", "%%%", "$$$")) for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        rows.append((at + i, " ".join(w).capitalize() + "." if not bad else " ".join(w)))
        labels.append((at + i, int(not bad), 0))
    return rows, labels


def test_quality_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    rows, labels = quality_corpus(1600, 100, rng)
    new, truth = quality_corpus(300, 5000, rng)
    positives = [x for x in labels if x[1]][::2]
    model = quality.fit(clashing(docs(spark, rows)), labels_table(spark, positives))
    assert 0.6 < model.prior < 0.9
    got = {r.doc_id: r.keep for r in quality.score(docs(spark, new), model).collect()}
    assert sum(got[d] == bool(q) for d, q, _ in truth) >= 0.98 * len(truth)


def plain_nnpu(p, u, prior, decay, steps=4000, rate=0.5):
    """The non-negative risk's plain gradient descent over all rows; weights of the standardised features."""
    w = np.zeros(p.shape[1])
    for _ in range(steps):
        sa, sb = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        ga, gb = (sa * (1 - sa)) @ p / len(p), (sb * (1 - sb)) @ u / len(u)
        negative = gb - prior * ga
        w -= rate * ((negative - prior * ga if sb.mean() >= prior * sa.mean() else -negative) + decay * w)
    return w


def test_quality_decides_as_plain_gradient_descent(spark):
    rng = random.Random(7)
    rows, labels = quality_corpus(1500, 100, rng)
    good = [x for x in labels if x[1]][::2]
    model = quality.fit(docs(spark, rows), labels_table(spark, good))
    x = quality.features([t for _, t in rows]).astype(float)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3, atol=1e-6)
    z = np.concatenate([((x - model.mean) / model.scale).clip(-8, 8), np.ones((len(x), 1))], 1)
    chosen = {d for d, *_ in good}
    w = plain_nnpu(z[[d in chosen for d, _ in rows]], z, model.prior, 1e-3)
    got = {r.doc_id: r.keep for r in quality.score(docs(spark, rows), model).collect()}
    agree = sum(got[d] == (m >= 0) for (d, _), m in zip(rows, z @ w, strict=True))
    assert agree >= 0.99 * len(rows)


def test_every_unlabelled_row_takes_part(spark, monkeypatch):
    """Sums over a table that is divided into parts are those over all its rows."""
    rng = random.Random(8)
    rows, labels = quality_corpus(400, 100, rng)
    seen, total = [], quality._total

    def counted(table, width, add):
        out = total(table, width, add)
        seen.append({r.doc_id for r in table.select("doc_id").collect()})
        return out

    monkeypatch.setattr(quality, "_total", counted)
    quality.fit(docs(spark, rows), labels_table(spark, labels), quality.Pu(batch=40))
    parts = seen[-quality.Pu().passes :]
    assert set.union(*parts) == {d for d, _ in rows} and max(map(len, parts)) < len(rows)


def test_prior_equals_a_search_over_all_cutoffs():
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, 7000), rng.normal(-3, 1, 3000)])
    count = lambda x: np.bincount(quality._bin(x), minlength=quality._BINS)
    margin = math.sqrt(math.log(4 / 0.1) / 2) * (3000**-0.5 + 10000**-0.5)
    best = min(((u >= c).mean() + margin) / (p >= c).mean() for c in np.linspace(-8, 2, 400) if (p >= c).mean() > 2 * margin)
    found = quality.prior_of(count(p), count(u), 0.1)
    assert abs(found - 0.7) < 0.03 and found <= best


def test_quality_odd_rows(spark):
    rng = random.Random(5)
    rows, labels = quality_corpus(300, 100, rng)
    model = quality.fit(docs(spark, rows + odd_rows()), labels_table(spark, labels))
    got = quality.score(clashing(docs(spark, odd_rows())), model).collect()
    assert len(got) == len(odd_rows()) and all(r.score == 0 and not r.keep for r in got if r.doc_id in (1, 2))
    assert quality.score(docs(spark, []), model).count() == 0
    assert quality.fit(docs(spark, rows), labels_table(spark, [])) is None
    assert quality.fit(docs(spark, []), labels_table(spark, labels)) is None
    assert [r.keep for r in quality.score(docs(spark, [(1, "text"), (2, None)]), None).collect()] == [True, False]
