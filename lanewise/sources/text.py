"""Small text inputs: pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pattern_lines(lines: DataFrame) -> DataFrame:
    """``pattern_no`` (from 1), ``pattern`` of the lines (``row_no``, ``line``) that aren't blank, trimmed and in upper case."""
    text = F.upper(F.btrim("line"))
    return lines.filter(F.coalesce(text, F.lit("")) != "").select(F.row_number().over(Window.orderBy("row_no")).alias("pattern_no"), text.alias("pattern"))


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """The patterns of a file with one on each line."""
    from lanewise.sources.files import lines_of

    return [t.upper() for line in lines_of(path) if (t := line.strip())]
