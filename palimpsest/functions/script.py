"""Script folding by the ICU rules that come with Spark, for all CJK characters."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession

from . import text as t

#: Unified ideographs and their first extension.
FIRST, LAST = 0x3400, 0x9FFF


def full_table(spark: SparkSession) -> tuple[str, str]:
    """Characters and what stands for each: its simplified form's traditional one, so that all forms of a character, 發 髮 and 发 alike,
    have one. Those that stand for themselves are left out. One call each way on the driver, for some 28 000 characters."""
    to = spark._jvm.com.ibm.icu.text.Transliterator.getInstance
    every = [chr(c) for c in range(FIRST, LAST + 1)]
    folded = to("Simplified-Traditional").transliterate(to("Traditional-Simplified").transliterate("\n".join(every))).split("\n")
    pairs = [(a, b) for a, b in zip(every, folded, strict=True) if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(spark: SparkSession, text: Column) -> Column:
    """``text.fold`` with the full table."""
    return t.fold(text, *full_table(spark))
