"""URL filter by a path-template tree.

A URL's path is a list of segments whose digit runs, long hexadecimal runs and
percent-escapes are generalised first (``/post-123`` is ``/post-<n>``), so pages
shrink to one row for each distinct shape of a host with its numbers of pages and
of good and bad labels.  The tree is then built on these rows, all hosts at once.  A
round takes every node to its next branching (segments that all its paths share are
literal, whatever their number) and decides there:

* a segment is small where a node has more than ``children`` different ones and
  it holds less than one in ``children`` of the node's pages; a small one whose
  bad share differs from that of the other small ones by no more than ``z``
  standard errors is a variable and becomes ``*``;
* larger siblings whose subtrees begin alike and whose bad shares differ from the
  rest of them, and from the node's variables, by no more than ``z`` standard
  errors are merged into ``*`` as well;
* what remains is literal, and so is judged by its own labels.

A template is rejected if its smoothed bad share,
(bad + strength * prior) / (labelled + strength) with the corpus's bad share as
prior, reaches ``purity``.

There are as many rounds as a path has branchings, not segments; a round works on the
shapes only and is a table in the shared folder.  Pages are read twice, for the shapes
and for the decision, and only their id and URL.

Defined results: a null or unparsable URL has the host "" and the path it shows;
query and fragment are ignored; a page without a label counts as a page only;
repeated rows are judged each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, written


@dataclass(frozen=True)
class Tree:
    children: int = 20
    z: float = 3.0
    strength: float = 8.0
    purity: float = 0.5


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def shape(url: Column) -> Column:
    """Path with its digits, hexadecimal names and escapes generalised; no empty segments."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(?:%[0-9A-Fa-f]{2})+", "<e>"), r"(?i)\b(?=[a-f]*[0-9])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*\b", "<n>")
    return F.regexp_replace(F.regexp_replace(path, r"[0-9]+", "<n>"), r"/{2,}", "/")


def document_of(url: Column) -> Column:
    """The number that ends a URL's path, which names its document in the supplied tables; null where there is none."""
    number = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"([0-9]{1,18})[^0-9/]*/?$", 1)
    return F.when(number != "", number.cast("long"))


def labelled_pages(pages: DataFrame, labels: DataFrame, document: Callable[[Column], Column] = document_of) -> DataFrame:
    """page_id, url and good (1, 0 or null) by the label of the document that the URL leads to."""
    known = labels.groupBy(labels["doc_id"].cast("long").alias("id")).agg(F.min(labels["quality"].cast("int")).alias("good"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), document(pages["url"]).alias("n"))
    return rows.join(known, rows["n"] == known["id"], "left").select("page_id", "url", "good")


def templates(pages: DataFrame, how: Tree = Tree()) -> DataFrame:
    """host, path (shape) and its template, of pages(url, good)."""
    keyed = pages.select(host(F.col("url")).alias("host"), shape(F.col("url")).alias("path"), "good")
    shapes = keyed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good") == 1, 1)).alias("g"), F.count(F.when(F.col("good") == 0, 1)).alias("b"))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    now = written(shapes.select("host", "path", "n", "g", "b", segments.alias("seg"), F.lit("").alias("t")), "tree")
    done = now.where(F.size("seg") == 0)
    while not now.where(F.size("seg") > 0).isEmpty():
        after = written(_round(now.where(F.size("seg") > 0), how).unionByName(now.where(F.size("seg") == 0)), "tree")
        drop(now)
        now = done = after
    return done.select("host", "path", "t", "n", "g", "b")


def _round(rows: DataFrame, how: Tree) -> DataFrame:
    """Append to every template what all paths of its node have, and one segment more where they differ."""
    node = rows.groupBy("host", "t").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"))
    # what the least and the greatest of ordered paths share, all between them share
    differs = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), False)
    shared = node.select("host", "t", F.when(differs == 0, F.size("lo")).otherwise(differs - 1).cast("int").alias("shared"))
    longer = F.concat("t", F.expr("array_join(transform(slice(seg, 1, shared), x -> concat('/', x)), '')"))
    rest = F.expr("slice(seg, shared + 1, size(seg))")
    out = ["host", "path", "n", "g", "b", "seg", "t"]
    at = rows.join(shared, ["host", "t"]).withColumns({"t": longer, "seg": rest}).select(*out)
    return _level(at, how).select(*out)


def _kind(segment: Column) -> Column:
    return F.when(segment.isNull(), "end").when(segment.contains("<n>"), "number").when(segment.contains("<e>"), "escape").otherwise("word")


def _apart(good: Column, bad: Column, rest_good: Column, rest_bad: Column) -> Column:
    """Standard errors between the bad shares of a segment and of the rest."""
    m, rest_m = good + bad, rest_good + rest_bad
    # shares with one half added to either side, so that a share of 0 or 1 has an error too
    # (null where the rest is none, as for a segment that is not among those it is compared with)
    p, q = F.try_divide(bad + 0.5, m + 1), F.try_divide(rest_bad + 0.5, rest_m + 1)
    return F.try_divide(F.abs(p - q), F.sqrt(F.try_divide(p * (1 - p), m + 1) + F.try_divide(q * (1 - q), rest_m + 1)))


def _level(rows: DataFrame, how: Tree) -> DataFrame:
    """Move the first segment of every path that has one to its template."""
    rows = rows.withColumns({"v": F.get("seg", F.lit(0)), "kind": _kind(F.get("seg", F.lit(1)))})
    going, ended = rows.where("v IS NOT NULL"), rows.where("v IS NULL").drop("v", "kind")
    child = going.groupBy("host", "t", "v").agg(F.sum("n").alias("cn"), F.sum("g").alias("cg"), F.sum("b").alias("cb"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("sig"))
    node = child.groupBy("host", "t").agg(F.sum("cn").alias("pn"), F.count(F.lit(1)).alias("k"))
    child = child.join(node, ["host", "t"]).withColumn("small", (F.col("k") > how.children) & (F.col("cn") * how.children < F.col("pn")))
    few = child.where("small").groupBy("host", "t").agg(F.sum("cg").alias("fg"), F.sum("cb").alias("fb"))
    child = child.join(few, ["host", "t"], "left")
    own = (F.col("cg"), F.col("cb"))
    child = child.withColumn("variable", F.col("small") & (_apart(*own, F.col("fg") - F.col("cg"), F.col("fb") - F.col("cb")) <= how.z))
    star = child.where("variable").groupBy("host", "t").agg(F.sum("cg").alias("vg"), F.sum("cb").alias("vb"))
    like = child.where("NOT small").groupBy("host", "t", "sig").agg(F.sum("cg").alias("sg"), F.sum("cb").alias("sb"), F.count(F.lit(1)).alias("brothers"))
    child = child.join(star, ["host", "t"], "left").join(like, ["host", "t", "sig"], "left")
    with_brothers = (F.col("brothers") > 1) & (_apart(*own, F.col("sg") - F.col("cg"), F.col("sb") - F.col("cb")) <= how.z)
    with_variables = F.col("vg").isNull() | (_apart(*own, F.col("vg"), F.col("vb")) <= how.z)
    alike = ~F.col("small") & with_brothers & with_variables
    word = F.when(F.col("variable") | alike, "*").otherwise(F.col("v"))
    step = child.select("host", "t", "v", F.concat_ws("/", "t", word).alias("new"))
    moved = going.join(step, ["host", "t", "v"]).select("host", "path", "n", "g", "b", F.expr("slice(seg, 2, size(seg))").alias("seg"), F.col("new").alias("t"))
    return moved.unionByName(ended)


def judge(pages: DataFrame, how: Tree = Tree()) -> DataFrame:
    """page_id, url, template, its pages and labels, smoothed bad share and keep, of pages(page_id, url, good)."""
    found = written(templates(pages, how), "templates")
    total = found.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum(F.col("g") + F.col("b"))), F.lit(0.0)).alias("prior"))
    sums = found.groupBy("host", "t").agg(F.sum("n").alias("pages"), F.sum("g").alias("good"), F.sum("b").alias("bad")).crossJoin(F.broadcast(total))
    share = (F.col("bad") + how.strength * F.col("prior")) / (F.col("good") + F.col("bad") + how.strength)
    by_path = found.select("host", "path", "t").join(sums.withColumn("bad_share", share), ["host", "t"])
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), shape(F.col("url")).alias("path"))
    return rows.join(by_path, ["host", "path"]).select("page_id", "url", F.concat("host", "t").alias("template"), "pages", "good", "bad", F.round("bad_share", 9).alias("bad_share"), (F.col("bad_share") < how.purity).alias("keep"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(written(labelled_pages(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")), "pages"))
