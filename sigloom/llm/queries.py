"""Queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP1_SQL, op1_decontamination
from .langid import OP9_SQL, op9_language
from .packing import op3_packing
from .pii import op6_pii
from .quality import op10_quality
from .rules import OP5_SQL, op5_rules
from .simhash import op2_simhash
from .toxicity import op8_toxicity
from .urls import op4_urls
from .warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_simhash": op2_simhash,
        "op3_packing": op3_packing,
        "op4_urls": op4_urls,
        "op5_rules": op5_rules,
        "op6_pii": op6_pii,
        "op7_warc": op7_warc,
        "op8_toxicity": op8_toxicity,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op5_rules": OP5_SQL,
        "op9_language": OP9_SQL,
    }
