import random

from sigloom.llm.decontaminate import Winnowing, drop_contaminated, find_spans

from .common import clashing, docs, odd_rows, prose, words


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, items, least):
    import re

    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in texts:
        for i, u in items:
            a, b = cut(t), cut(u)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y] and (x == 0 or y == 0 or a[x - 1] != b[y - 1]):
                        n = 0
                        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                            n += 1
                        if n >= least:
                            out.add((d, i, x, y, n))
    return out


def planted():
    rng = random.Random(1)
    items = [(i, prose(rng, 40)) for i in range(6)]
    texts = [(i, prose(rng, 60)) for i in range(12)]
    for k in range(8):
        w = items[k % 6][1].split()
        at, n = rng.randint(0, 15), rng.choice([12, 13, 14, 20])
        texts.append((100 + k, " ".join([*words(rng, 20), *w[at : at + n], *words(rng, 9)])))
    return texts, items


def test_equals_brute_force_on_both_paths(spark):
    texts, items = planted()
    expected = brute(texts, items, 13)
    assert {n for *_, n in expected}
    for limit in (10**6, 1):
        got = find_spans(docs(spark, texts), benchmark(spark, items), Winnowing(broadcast_bytes=limit)).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_drops_only_what_shares_a_span(spark):
    texts, items = planted()
    bad = {d for d, *_ in brute(texts, items, 13)}
    for limit in (10**6, 1):
        kept = drop_contaminated(clashing(docs(spark, texts)), benchmark(spark, items), Winnowing(broadcast_bytes=limit))
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in texts} - bad
        assert kept.columns == clashing(docs(spark, texts)).columns


def test_odd_rows_and_empty_tables(spark):
    odd, items = docs(spark, odd_rows()), benchmark(spark, [(1, None), (2, ""), (None, "the ring is on the re"), (3, "short")])
    for limit in (10**6, 1):
        how = Winnowing(broadcast_bytes=limit)
        assert find_spans(clashing(odd), items, how).count() == 0
        assert drop_contaminated(odd, items, how).count() == odd.count()
        assert find_spans(odd.limit(0), items, how).count() == 0 and find_spans(odd, items.limit(0), how).count() == 0


def test_repeated_rows_give_one_row(spark):
    texts, items = planted()
    assert find_spans(docs(spark, texts + texts), benchmark(spark, items + items)).count() == len(brute(texts, items, 13))
