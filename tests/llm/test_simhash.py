import random

import numpy as np
import pytest

from sigloom.llm import simhash
from sigloom.llm.simhash import RADIUS, components, drop_near_duplicates, fingerprints, near_duplicates, pairs

from .common import clashing, docs, odd_rows, prose, words


def copies():
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.choice([8, 40, 200]))) for i in range(60)]
    for k in range(40):
        w = rows[k][1].split()
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000 + i, rows[7][1]) for i in range(50)]


def brute(rows):
    """{doc_id: (group, size)} of the documents with copies."""
    code, has = fingerprints([t or "" for _, t in rows])
    d = np.bitwise_count(code[:, None, :] ^ code[None, :, :]).sum(2)
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in zip(*np.nonzero(d <= RADIUS), strict=True):
        if a < b and has[a] and has[b] and root(a) != root(b):
            group[max(root(a), root(b))] = min(root(a), root(b))
    members = {}
    for i in range(len(rows)):
        if has[i]:
            members.setdefault(root(i), []).append(rows[i][0])
    return {m: (min(v), len(v)) for v in members.values() if len(v) > 1 for m in v}


def test_equals_brute_force(spark):
    rows = copies()
    expected = brute(rows)
    assert len(expected) > 80
    got = near_duplicates(clashing(docs(spark, rows))).collect()
    assert {r.doc_id: (r.group_id, r.group_size) for r in got} == expected and len(got) == len(expected)
    assert all(r.keep == (r.doc_id == r.group_id) for r in got)


def test_one_of_each_group_stays(spark):
    rows = copies()
    expected = brute(rows)
    kept = drop_near_duplicates(clashing(docs(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in expected or expected[d][0] == d)
    assert kept.columns == clashing(docs(spark, rows)).columns


@pytest.mark.parametrize("radius", [0, 5, 11, 17])
def test_pair_search_is_exact(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, (30, 2), dtype=np.uint64)
    codes = [base]
    for _ in range(4):
        more = base.copy()
        for row in more:
            for bit in rng.choice(128, rng.integers(1, 22), replace=False):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        codes.append(more)
    c = np.unique(np.concatenate(codes), axis=0).view(np.int64)
    d = np.bitwise_count((c[:, None, :] ^ c[None, :, :]).view(np.uint64)).sum(2)
    expected = {frozenset((tuple(c[a].tolist()), tuple(c[b].tolist()))) for a, b in zip(*np.nonzero(d <= radius), strict=True) if a < b}
    got = pairs(spark.createDataFrame(c.tolist(), "lo long, hi long"), radius).collect()
    assert {frozenset(((r.a.lo, r.a.hi), (r.b.lo, r.b.hi))) for r in got} == expected and len(got) == len(expected)


def test_too_large_a_radius_is_refused(spark):
    with pytest.raises(ValueError):
        pairs(spark.createDataFrame([], "lo long, hi long"), 18)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (500, 500)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: l for n, l in found.items() if n != l} == {i: 0 for i in range(1, 61)} | {200: 100, 300: 100}


def test_odd_rows(spark):
    rows = odd_rows()
    kept = drop_near_duplicates(clashing(docs(spark, rows))).collect()
    ids = [r.doc_id for r in kept]
    # (6, t) twice and (None, t) are one group; what has no word all stays, repeated or not
    assert ids.count(6) == 1 and ids.count(None) == 1 and [r.text for r in kept if r.doc_id is None] == [None]
    assert sorted(i for i in ids if i is not None) == sorted([6, *(i for i, *_ in rows if i not in (None, 6))])
    found = near_duplicates(docs(spark, rows)).collect()
    assert len(found) == 3 and sum(r.keep for r in found) == 1 and {r.group_size for r in found} == {3}
    assert near_duplicates(docs(spark, [])).count() == 0 and drop_near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [simhash.BROADCAST_KEYS, 0])
def test_one_of_repeated_rows_is_kept(spark, monkeypatch, limit):
    """The same by broadcast and by shuffle; rows without a fingerprint are no copies, even if equal."""
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", limit)
    rows = [(None, None), (7, ""), (8, "%%%"), (9, None)] * 2 + [(6, "the ring is on the re")] * 4 + [(5, "another text with words")]
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, None), (7, ""), (8, "%%%"), (9, None)] * 2 + [(6, "the ring is on the re"), (5, "another text with words")], key=str)
    found = near_duplicates(docs(spark, rows)).collect()
    assert [r.doc_id for r in found] == [6] * 4 and sum(r.keep for r in found) == 1


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def recorded(monkeypatch):
    """The plans of all tables that are written from now on."""
    plans, plain = [], simhash.written

    def written(df, name):
        plans.append(plan(df))
        return plain(df, name)

    monkeypatch.setattr(simhash, "written", written)
    return plans


def test_many_lost_keys_do_not_go_through_the_driver(spark, monkeypatch):
    """Neither on the way to the lost keys nor with them, though these tables are small enough for Spark to broadcast them."""
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    plans = recorded(monkeypatch)
    last = plan(drop_near_duplicates(docs(spark, [*copies(), (1, "one text"), (1, "one text")])))
    assert "LeftAnti" in last and "LeftSemi" in last and len(plans) > 4
    assert not any("Broadcast" in p for p in [*plans, last])


def test_search_and_groups_do_not_go_through_the_driver(spark, monkeypatch):
    """Spark would broadcast these tables: its estimate does not count the entries of each fingerprint."""
    plans = recorded(monkeypatch)
    plans.append(plan(near_duplicates(docs(spark, copies()))))
    assert sum("SortMergeJoin" in p for p in plans) > 2
    assert not any("Broadcast" in p for p in plans)
