"""Quality rules whose cutoffs limit false rejection with a guarantee.

A rule rejects a document when a statistic of its text exceeds a cutoff.  The
cutoffs are not chosen by eye: for each stratum (declared language) and rule, the
documents labelled good are a holdout, and a cutoff is certified only if the
exact binomial test rejects "more than ``alpha / rules`` of the good documents
would be lost" at level ``delta / (strata * rules)`` (Bonferroni over all tested
sequences).  Along one rule's cutoffs testing goes from the most lenient to the
strictest and stops at the first that fails (fixed sequence), so no further
correction is needed; the strictest certified cutoff is used, and where none is
certified the rule rejects nothing.  With probability 1 - ``delta`` every
stratum then loses at most ``alpha`` of its good documents.

The statistics are one pass of the vectorised kernel over the texts, kept as a
table of small numbers in the shared folder; the counts that reach the test
are strata x rules x cutoffs, whatever the corpus.  Statistics are whole
thousandths (or tenths for the word length), so cutoffs are compared exactly.
``blank`` is 1000 for a text without a letter and 0 for any other.

Defined results: a null language is the stratum "none"; null texts count as
empty; repeated rows are judged each, and a repeated or doubly labelled id
counts once for each row, by its least label; an empty table gives no rows;
a long text is read in parts; extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written
from .textkernel import Hashed, Words, by_block, is_long, parts

#: Cutoffs of each rule from lenient to strict.
CUTOFFS = {
    "symbols": (400, 200, 150, 100, 80, 60, 40, 30, 20),
    "capitals": (900, 700, 500, 400, 300, 200, 150, 100),
    "repeats": (600, 400, 300, 200, 150, 100, 50),
    "lines": (800, 600, 500, 400, 300, 200),
    "width": (150, 120, 100, 90, 80, 75, 70),
    "blank": (500,),
}
_SIGNS = frozenset("#$%&*+/<=>@^_`{}~|!")


@dataclass(frozen=True)
class Risk:
    alpha: float = 0.05
    delta: float = 0.05


def _class_of(cp: int) -> int:
    """1 for a letter, 2 for a capital, 4 for a sign, 8 for a letter or number, added up."""
    ch = chr(cp)
    kind = unicodedata.category(ch)
    return (kind[0] == "L") + 2 * (kind == "Lu") + 4 * (ch in _SIGNS) + 8 * (kind[0] in "LN")


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    return np.array([_class_of(cp) for cp in range(65536)], np.uint8)


def _classes(cps: np.ndarray) -> np.ndarray:
    high = cps > 0xFFFF
    if not high.any():
        return _class_table()[cps]
    out = _class_table()[np.where(high, 0, cps)]
    for cp in np.unique(cps[high]):
        out[cps == cp] = _class_of(int(cp))
    return out


def _in_line(cps: np.ndarray) -> np.ndarray:
    """What a line is made of."""
    return np.where(cps == 10, 0, cps + np.uint32(1))


def _repeated(words: Words | Hashed) -> np.ndarray:
    """Words equal to the one before them, of each document."""
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    return np.bincount(words.doc[1:], weights=same, minlength=words.n)


def _distinct(lines: Words | Hashed) -> np.ndarray:
    order = np.lexsort((lines.hash, lines.doc))
    h, d = lines.hash[order], lines.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d, weights=new, minlength=lines.n)


def measured(texts: list[str]) -> dict[str, np.ndarray]:
    """letters and the statistic of each rule of a block of texts."""
    if is_long(texts):
        words, lines, size = Hashed(texts), Hashed(texts, _in_line), np.array([len(texts[0])])
        totals = np.zeros((4, 1), np.int64)
        for cps in parts(texts[0]):
            kinds = _classes(cps)
            totals += np.array([[np.count_nonzero(kinds & bit)] for bit in (1, 2, 4, 8)])
    else:
        words, lines = Words(texts), Words(texts, _in_line)
        kinds, size = _classes(words.cps), words.lens
        totals = []
        for bit in (1, 2, 4, 8):
            up_to = np.concatenate([[0], np.cumsum(kinds & bit > 0)])
            totals.append(up_to[words.origin + size] - up_to[words.origin])
    letters, upper, signs, inside = totals
    share = lambda part, whole, unit=1000: np.where(whole > 0, unit * part.astype(np.int64) // np.maximum(1, whole), 0)
    return {
        "letters": letters,
        "symbols": share(signs, size),
        "capitals": share(upper, letters),
        "repeats": share(_repeated(words), words.count),
        "lines": share(lines.count - _distinct(lines), lines.count),
        "width": share(inside, words.count, 10),
        "blank": np.where(letters > 0, 0, 1000),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, letters and the statistic of each rule."""
    names = ["letters", *CUTOFFS]

    def work(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = measured(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[n], pa.int64()) for n in names]], names=["doc_id", "stratum", *names])

    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("none")).alias("stratum"), docs["text"].cast("string").alias("text"))
    return base.mapInArrow(lambda it: by_block(it, "text", work), "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in names))


def at_most(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from the largest term of the tail that k begins."""
    if k >= n:
        return 1.0
    upper = k > n * p
    i = k + 1 if upper else k
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while 0 <= i <= n and term > total * 1e-17:
        total += term
        term *= (n - i) / (i + 1) * p / (1 - p) if upper else i / (n - i + 1) * (1 - p) / p
        i += 1 if upper else -1
    return max(0.0, 1 - total) if upper else min(1.0, total)


def thresholds(stats: DataFrame, labels: DataFrame, how: Risk = Risk()) -> DataFrame:
    """stratum, rule, cutoff (null where none is certified), with the holdout's size and losses at the cutoff."""
    good = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("q")).groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1")
    held = stats.join(good.select("doc_id"), "doc_id", "left_semi")
    sums = [F.count(F.when(F.col(rule) > c, 1)).alias(f"{rule}_{c}") for rule, cuts in CUTOFFS.items() for c in cuts]
    counts = stats.select("stratum").distinct().join(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums), "stratum", "left").fillna(0)
    long = counts.select("stratum", "n", F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).cast("long").alias("cutoff"), F.col(f"{rule}_{c}").alias("lost")) for rule, cuts in CUTOFFS.items() for i, c in enumerate(cuts)])).alias("t")).select("stratum", "n", "t.*")
    risk, rules, strata = how.alpha / len(CUTOFFS), len(CUTOFFS), max(1, stats.select("stratum").distinct().count())

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=[at_most(int(k), int(n), risk) if n else 1.0 for k, n in zip(b.lost, b.n, strict=True)])

    tested = long.mapInPandas(test, "stratum string, n long, rule string, step int, cutoff long, lost long, p double")
    level = F.lit(how.delta / (strata * rules))
    sequence = Window.partitionBy("stratum", "rule").orderBy("step")
    passed = tested.withColumn("pass", (F.col("p") <= level).cast("int")).withColumn("open", F.min("pass").over(sequence))
    return passed.groupBy("stratum", "rule").agg(F.max("n").alias("n"), F.max(F.when(F.col("open") == 1, F.struct("step", "cutoff", "lost"))).alias("best")).select("stratum", "rule", "n", F.col("best.cutoff").alias("cutoff"), F.col("best.lost").alias("lost"))


def apply(docs: DataFrame, labels: DataFrame, how: Risk = Risk()) -> DataFrame:
    """doc_id, stratum, the statistics, the number of rules that reject, and keep, of every row."""
    stats = written(statistics(docs), "statistics")
    found = thresholds(stats, labels, how).groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.first("cutoff"))
    cut = found.select(F.col("stratum").alias("__s"), *[F.col(r).alias(f"__{r}") for r in CUTOFFS])
    fails = sum((F.when(F.col(r) > F.col(f"__{r}"), 1).otherwise(0) for r in CUTOFFS), F.lit(0))
    joined = stats.join(cut, F.col("stratum") == F.col("__s"), "left").withColumn("rejections", fails.cast("long"))
    return joined.select("doc_id", "stratum", "letters", *CUTOFFS, "rejections", (F.col("rejections") == 0).alias("keep"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_STEPS = ", ".join(f"('{rule}', {i}, {c})" for rule, cuts in CUTOFFS.items() for i, c in enumerate(cuts))
_VALUE = " ".join(f"WHEN '{r}' THEN {r}" for r in CUTOFFS)
_FAIL = " + ".join(f"CASE WHEN {r} > (SELECT cutoff FROM best WHERE best.stratum = stats.stratum AND rule = '{r}') THEN 1 ELSE 0 END" for r in CUTOFFS)

OP5_SQL = rf"""
WITH made AS (
  SELECT doc_id, coalesce(lang, 'none') AS stratum, length(t) AS n, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper_,
    length(regexp_replace(t, '[^#$%&*+/<=>@^_`{{}}~|!]', '', 'g')) AS signs, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS inside
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
stats AS (
  SELECT doc_id, stratum, letters::BIGINT AS letters,
    CASE WHEN n > 0 THEN 1000 * signs // n ELSE 0 END::BIGINT AS symbols,
    CASE WHEN letters > 0 THEN 1000 * upper_ // letters ELSE 0 END::BIGINT AS capitals,
    CASE WHEN len(w) > 0 THEN 1000 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) // len(w) ELSE 0 END::BIGINT AS repeats,
    CASE WHEN len(l) > 0 THEN 1000 * (len(l) - len(list_distinct(l))) // len(l) ELSE 0 END::BIGINT AS lines,
    CASE WHEN len(w) > 0 THEN 10 * inside // len(w) ELSE 0 END::BIGINT AS width,
    CASE WHEN letters > 0 THEN 0 ELSE 1000 END::BIGINT AS blank
  FROM made),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM stats WHERE doc_id IN (SELECT doc_id FROM good)),
steps(rule, step, cutoff) AS (VALUES {_STEPS}),
strata AS (SELECT DISTINCT stratum FROM stats),
counts AS (
  SELECT s.stratum, t.rule, t.step, t.cutoff, count(h.doc_id) AS n, count(CASE WHEN CASE t.rule {_VALUE} END > t.cutoff THEN 1 END) AS lost
  FROM strata s CROSS JOIN steps t LEFT JOIN held h ON h.stratum = s.stratum GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6)))) END AS p FROM counts),
passed AS (
  SELECT *, min(CASE WHEN p <= 0.05 / ((SELECT count(*) FROM strata) * 6) THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS open FROM tested),
best AS (SELECT stratum, rule, min(CASE WHEN open = 1 THEN cutoff END) AS cutoff FROM passed GROUP BY stratum, rule),
judged AS (SELECT *, ({_FAIL})::BIGINT AS rejections FROM stats)
SELECT *, rejections = 0 AS keep FROM judged
"""
