"""Hosts with more sections than Tree.children."""

from sigloom.llm.urls import Tree, judge, templates

from .test_urls import SCHEMA

BAD, GOOD = 0, 1


def section(first, name, n, good):
    return [(first + i, f"http://big.example.com/{name}/{i}", good) for i in range(n)]


def words(n, salt=""):
    return [salt + "".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(n)]


def lost(spark, rows):
    return {r.page_id for r in judge(spark.createDataFrame(rows, SCHEMA)).collect() if not r.keep}


def test_one_bad_section_of_many(spark):
    rows = [r for k, w in enumerate(words(24)) for r in section(1000 * k, w, 40, GOOD)] + section(90_000, "casino", 40, BAD)
    assert lost(spark, rows) == set(range(90_000, 90_040))


def test_two_bad_sections_stay_apart_from_the_good_ones(spark):
    rows = [r for k, w in enumerate(words(40)) for r in section(1000 * k, w, 40, GOOD)]
    rows += section(90_000, "casino", 40, BAD) + section(91_000, "pills", 40, BAD)
    assert lost(spark, rows) == {*range(90_000, 90_040), *range(91_000, 91_040)}


def test_large_bad_sections_do_not_drag_the_small_ones_along(spark):
    rows = [r for k, w in enumerate(words(40)) for r in section(1000 * k, w, 20, GOOD)]
    rows += section(90_000, "casino", 600, BAD) + section(91_000, "pills", 600, BAD)
    assert lost(spark, rows) == {*range(90_000, 90_600), *range(91_000, 91_600)}


def test_small_sections_without_significance_are_one_template(spark):
    rows = [r for k, w in enumerate(words(60)) for r in section(1000 * k, w, 3, None if k % 2 else GOOD)] + section(90_000, "odd", 1, BAD)
    assert {r.t for r in templates(spark.createDataFrame(rows, SCHEMA), Tree()).collect()} == {"/*/<n>"}
