"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import sql
from corpusforge.llm.decontamination import op10_decontamination
from corpusforge.llm.language_id import op6_language_id
from corpusforge.llm.licenses import op2_license_scan
from corpusforge.llm.lines import op7_line_dedup
from corpusforge.llm.mixing import op3_mixing
from corpusforge.llm.neardup import op1_minhash
from corpusforge.llm.quality_classifier import op8_quality_classifier
from corpusforge.llm.quality_rules import op9_quality_rules
from corpusforge.llm.substrings import op5_substring_dedup
from corpusforge.llm.suffixes import op4_suffix_array


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_license_scan, op3_mixing, op4_suffix_array, op5_substring_dedup, op6_language_id, op7_line_dedup, op8_quality_classifier, op9_quality_rules, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
