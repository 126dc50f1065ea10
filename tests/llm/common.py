"""Small tables for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the re an on er in ed th ing tion es is".split(), "de": "der ung ich ein sch heit en zu ü ber".split()}


def words(rng: random.Random, n: int, lang: str = "en") -> list[str]:
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(words(rng, n, lang)).capitalize() + "."


def odd_rows() -> list[tuple]:
    """Null and empty texts, ids and languages, repeated rows (also without a word), signs only, long texts: prose, white space, without a space."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t", None, None, 5), (None, "the ring is on the re", "en", "a", 21), (None, None, None, None, None),
        (5, "%%% ### $$$", "de", "b", 11), (6, "the ring is on the re", "en", "a", 21), (6, "the ring is on the re", "en", "a", 21), (7, long, "en", "a", len(long)), (8, "x", "en", "a", 1), (9, "🙂 𝔘𝔫𝔦 ıİ", "en", "a", 8),
        (2, "", "en", "a", 0), (5, "%%% ### $$$", "de", "b", 11), (10, " \n" * 150_000, "en", "a", 300_000), (11, "0af3" * 80_000, "en", "a", 320_000),
    ]


def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """More columns, named like those that the operators make themselves."""
    names = ["key", "k1", "k2", "lo", "hi", "m", "n", "t", "rank", "label", "pack_id", "length", "spans", "score", "keep", "stratum", "host", "path", "id", "good", "seg", "letters", "e", "g", "b"]
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in names})
