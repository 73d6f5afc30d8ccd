"""Statistics of pattern matches over reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import fuzzy
from lanewise.runtime import checkpointed, fresh_name
from lanewise.schema import MATCH


def found_in(sequence: Column, patterns: list[str], errors: int, kind: str) -> Column:
    every = F.array(*[F.struct(F.lit(i).alias("pattern_no"), fuzzy.search(sequence, p, errors, kind).alias("m")) for i, p in enumerate(patterns, start=1)])
    return F.filter(every, lambda f: f["m"].isNotNull())


def matches(reads: DataFrame, patterns: list[str], errors: int = 0, kind: str = "s") -> DataFrame:
    """Each read with each pattern it matches: the reads' columns, ``pattern_no`` (from 1), ``errors``, ``captures``; one pass for all patterns."""
    found = fresh_name(reads, "found")
    return reads.withColumn(found, F.explode(found_in(F.col("sequence"), patterns, errors, kind))).select(
        *reads.columns, f"{found}.pattern_no", f"{found}.m.errors", f"{found}.m.captures")


def tally(reads: DataFrame, patterns: list[str], errors: int = 0, kind: str = "s") -> tuple[DataFrame, int]:
    """The counts of ``match_counts`` and the number of all reads, from one pass: a read also counts for pattern 0."""
    whole = F.array(F.struct(F.lit(0).alias("pattern_no"), F.lit(None).cast(MATCH).alias("m")))
    each = reads.select("pos", F.explode(F.concat(whole, found_in(F.col("sequence"), patterns, errors, kind))).alias("f"))
    counts = checkpointed(match_counts(each.select("pos", "f.pattern_no", "f.m.errors", "f.m.captures"), 1))
    total = (counts.filter("pattern_no = 0").first() or {"cnt": 0})["cnt"]
    return counts.filter("pattern_no > 0").withColumn("share", F.col("cnt") / F.lit(float(total or 1))), total


def match_counts(found: DataFrame, total: int) -> DataFrame:
    """``pattern_no``, ``errors``, ``captures``, ``cnt``, ``first``, ``share`` of all ``total`` reads."""
    counts = found.groupBy("pattern_no", "errors", "captures").agg(F.count("*").alias("cnt"), F.min("pos").alias("first"))
    return counts.withColumn("share", F.col("cnt") / F.lit(float(total)))


def error_totals(counts: DataFrame, patterns: int, errors: int, total: int) -> DataFrame:
    """Matches at every level of errors from 0 to ``errors``, those without any included."""
    levels = counts.sparkSession.range(1, patterns + 1).select(F.col("id").cast("int").alias("pattern_no"), F.explode(F.sequence(F.lit(0), F.lit(errors))).alias("errors"))
    sums = counts.groupBy("pattern_no", "errors").agg(F.sum("cnt").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return levels.join(sums, ["pattern_no", "errors"], "left").select("pattern_no", "errors", n.alias("cnt"), (n / F.lit(float(total))).alias("share"))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def match_report(counts: DataFrame) -> DataFrame:
    """Lines of the report: errors, captures padded to the longest of the pattern, count, per cent; ordered."""
    text = counts.withColumn("text", F.array_join("captures", " "))
    longest = text.groupBy("pattern_no").agg(F.max(F.length("text")).alias("longest"))
    order = Window.partitionBy("pattern_no").orderBy("errors", F.col("cnt").desc(), "first", "text")
    line = F.concat_ws(" ", F.col("errors").cast("string"), F.concat(F.col("text"), F.repeat(F.lit(" "), F.col("longest") - F.length("text"))), F.col("cnt").cast("string"), percent(F.col("share")))
    return text.join(longest, "pattern_no").select("pattern_no", F.row_number().over(order).alias("line_no"), line.alias("line"))


def error_report(totals: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", F.col("errors").cast("string"), F.col("cnt").cast("string"), percent(F.col("share")))
    return totals.select("pattern_no", F.col("errors").alias("line_no"), line.alias("line"))


def pattern_distances(spark, patterns: list[str]) -> DataFrame:
    """Smallest edit distance between the expansions of each two patterns: ``a_no``, ``b_no``, ``distance``."""
    rows = [(i, s) for i, p in enumerate(patterns, start=1) for s in fuzzy.expand(p)]
    a = spark.createDataFrame(rows, "a_no int, a string")
    b = a.select(F.col("a_no").alias("b_no"), F.col("a").alias("b"))
    return a.join(b, F.col("a_no") < F.col("b_no")).groupBy("a_no", "b_no").agg(F.min(F.levenshtein("a", "b")).alias("distance"))


def safe_distance(spark, patterns: list[str], wanted: int) -> int:
    """The largest distance up to ``wanted`` at which no sequence can fit two patterns; raises if two of them share one."""
    least = pattern_distances(spark, patterns).agg(F.min("distance")).first()[0]
    if least == 0:
        raise ValueError("two patterns share a sequence")
    return wanted if least is None else min(wanted, (least - 1) // 2)
