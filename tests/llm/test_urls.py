import re
from collections import defaultdict

from sigloom.llm.urls import Tree, judge, labelled_pages, templates

from .common import clashing

SCHEMA = "page_id long, url string, good int"


def brute(rows, how):
    """{(host, path): template} by walking each host's tree in Python."""
    shapes = defaultdict(lambda: [0, 0, 0])
    for _, url, good in rows:
        url = url or ""
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
        host = m.group(1).lower() if m else ""
        path = re.sub(r"[0-9]+", "<n>", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "", url))
        x = shapes[host, re.sub("/{2,}", "/", path)]
        x[0] += 1
        x[1] += good == 1
        x[2] += good == 0
    seg = {k: [s for s in k[1].split("/") if s] for k in shapes}
    kind = lambda s, d: "end" if len(s) <= d else "number" if "<n>" in s[d] else "word"
    t = {k: "" for k in shapes}
    for d in range(max([0, *map(len, seg.values())])):
        nodes = defaultdict(lambda: defaultdict(list))
        for k in shapes:
            if len(seg[k]) > d:
                nodes[k[0], t[k]][seg[k][d]].append(k)
        for children in nodes.values():
            stat = {v: [sum(shapes[k][i] for k in ks) for i in range(3)] for v, ks in children.items()}
            sig = {v: tuple(sorted({kind(seg[k], d + 1) for k in ks})) for v, ks in children.items()}
            total = sum(s[0] for s in stat.values())
            variable = {v for v in children if len(children) > how.children and stat[v][0] * how.children < total}
            for v, ks in children.items():
                like = [x for x in children if x not in variable and sig[x] == sig[v]]
                g, b = (sum(stat[x][i] for x in like) - stat[v][i] for i in (1, 2))
                p, q = (stat[v][2] + 0.5) / (stat[v][1] + stat[v][2] + 1), (b + 0.5) / (g + b + 1)
                same = v not in variable and len(like) > 1 and abs(p - q) / (p * (1 - p) / (stat[v][1] + stat[v][2] + 1) + q * (1 - q) / (g + b + 1)) ** 0.5 <= how.z
                for k in ks:
                    t[k] += "/" + ("*" if v in variable or same else v)
    return t, shapes


def pages():
    rows = []
    for i in range(200):
        rows.append((i, f"https://shop.example.com/item-{i}/view", 1))
        rows.append((1000 + i, f"http://shop.example.com/{('en', 'de')[i % 2]}/{i}.html?x=1", i % 7 and 1))
        rows.append((2000 + i, f"http://u:p@SHOP.example.com:80/spam/{i}", 0))
        rows.append((3000 + i, f"http://blog.example.com/{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3}/post", None if i % 2 else 1))
    return rows + [(9000, None, None), (9001, "", 1), (9002, "no url", None), (9003, "http://blog.example.com", 1), (None, "http://blog.example.com/", 1), (9003, "http://blog.example.com", 1)]


def test_equals_brute_force(spark):
    rows = pages()
    expected, shapes = brute(rows, Tree())
    got = {(r.host, r.path): r.t for r in templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected and len(set(expected.values())) < len(expected)


def test_bad_templates_go_whole(spark):
    rows = pages()
    got = judge(clashing(spark.createDataFrame(rows, SCHEMA).drop("good")).drop("good").join(spark.createDataFrame(rows, SCHEMA).select("page_id", "good").distinct(), "page_id", "left")).collect()
    assert len(got) == len(rows)
    lost = {r.page_id for r in got if not r.keep}
    assert lost == set(range(2000, 2200))


def test_labels_by_the_number_of_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a/en/25?page=2#x"), (2, "http://a/7.html"), (3, "http://a/x"), (4, None), (5, "http://a/" + "9" * 30)], "page_id long, url string")
    labels = spark.createDataFrame([(25, 1), (25, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    assert {r.page_id: r.good for r in labelled_pages(clashing(pages), labels).collect()} == {1: 0, 2: 1, 3: None, 4: None, 5: None}


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
