"""Index mixing: barcodes of undetermined reads that belong to samples of other lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.runtime import written

POLY_G = "GGGG"
TOP = 1000


def barcode_counts(reads: DataFrame) -> DataFrame:
    """``file``, ``Lane``, ``Undetermined_Index``, ``Count``, ``first``: reads of each barcode, combined map-side; null barcodes don't count."""
    return every_count(reads).filter("Undetermined_Index is not null")


def every_count(reads: DataFrame) -> DataFrame:
    return reads.groupBy("file", "Lane", "Undetermined_Index").agg(F.count("*").alias("Count"), F.min("pos").alias("first"))


def top_barcodes(reads: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` barcodes of each file with their share of all its reads (poly-G ones and reads without barcode included, though never listed).

    ``reads``: file, Lane, Undetermined_Index, pos. Ties go to the barcode seen first. Reads are
    scanned and shuffled once, as counts: the totals are sums of the same counts, whose exchange
    both branches read. So that it stays the same in both, what isn't listed is ranked last and
    left out behind the window, and the totals ask for the first places too. The rank filter
    becomes a window group limit before its exchange: a file sends at most ``top`` rows per task.
    """
    counts = every_count(reads)
    totals = counts.groupBy("file").agg(F.sum("Count").alias("total"), F.min("first").alias("begin"))
    listed = F.coalesce(~F.col("Undetermined_Index").contains(POLY_G), F.lit(False))
    order = Window.partitionBy("file").orderBy(F.col("listed").desc(), F.col("Count").desc(), "first", "Undetermined_Index")
    best = counts.withColumn("listed", listed).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).filter("listed")
    share = F.when(F.col("begin").isNotNull() | F.col("total").isNotNull(), F.col("Count") / F.col("total"))
    return best.join(totals, "file").select("file", "Lane", "Undetermined_Index", "Count", share.alias("Fraction"))


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` without ``text``, a row for each ``form``: hash of the text with one character left out, and its place; texts of a length that differ in one place share one."""
    at, whole = F.col("form"), F.col(text)
    rows = df.withColumn("form", F.explode(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))))
    return rows.withColumn("form", F.xxhash64(F.substr(whole, F.lit(1), at - 1), at, F.substr(whole, at + 1))).drop(text)


def with_windows(df: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """``df`` with ``part``, a row for each part of ``text`` of one of these lengths. Exploded step by step, which stays in generated code."""
    rows = df.withColumn("size", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).filter(F.length(text) >= F.col("size"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("size") + 1)))
    return rows.withColumn("part", F.substr(F.col(text), F.col("part"), F.col("size"))).drop("size")


def within_one(text: Column, index: Column) -> Column:
    """Whether some window of ``text`` differs from ``index`` in one place at most; an empty index always fits."""
    places = F.sequence(F.lit(1), F.length(text) - F.length(index) + 1)
    differs = lambda at: F.size(F.filter(F.sequence(F.lit(1), F.length(index)), lambda j: F.substr(text, at + j - 1, F.lit(1)) != F.substr(index, j, F.lit(1)))) <= 1
    return F.when(F.length(index) == 0, True).when(F.length(index) > F.length(text), False).otherwise(F.exists(places, differs))


def index_mixing(sheet: DataFrame, barcodes: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Barcodes that fit a sample of another lane, within one substitution for each index.

    ``run`` names columns of both sides (and of the result, in front) that tell runs apart, if
    there are several. ``sheet``: Lane, Sample_Project, index1, index2 (null: not asked for; a null index1 never
    fits); ``barcodes``: Lane, Undetermined_Index, Count, Fraction, and any others that are kept out. An index may lie
    anywhere in the barcode, across its ``+`` too. Repeated rows of either side give repeated hits.

    Texts of one length differ in at most one place just if they share a form with one place
    masked; so windows of the barcodes and first indexes of the sheet meet in an equi-join on
    hashes of such forms, in place of a comparison of all pairs. Both indexes are compared for
    the pairs that are left.
    """
    run = run or []
    samples = sheet.filter("index1 is not null").groupBy(*run, "Lane", "Sample_Project", "index1", "index2").agg(F.count("*").alias("times"))
    found = barcodes.filter("Undetermined_Index is not null").groupBy(*run, "Lane", "Undetermined_Index", "Count", "Fraction").agg(F.count("*").alias("again"))
    lengths = [r[0] for r in samples.select(F.length("index1")).distinct().collect()]
    text = F.col("Undetermined_Index")
    left = with_forms(samples.select(*run, F.col("Lane").alias("Lane_Project"), "Sample_Project", "index1", "index2", "times", F.col("index1").alias("part")), "part")
    left = written(left)  # its size is known then: where sheets are few, the barcodes' rows needn't be shuffled
    # a barcode becomes a hundred rows, which its size before doesn't tell: not to be coalesced
    spread = found.repartition(max(found.sparkSession.sparkContext.defaultParallelism, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    right = with_forms(with_windows(spread, "Undetermined_Index", lengths), "part")
    pairs = right.join(left, [*run, "form"]).filter(F.col("Lane") != F.col("Lane_Project")).drop("form").distinct()
    fits = pairs.filter(within_one(text, F.col("index1"))).filter(F.col("index2").isNull() | within_one(text, F.col("index2")))
    copies = F.explode(F.array_repeat(F.lit(1), (F.col("times") * F.col("again")).cast("int"))).alias("one")
    return fits.select(*run, "Lane", "Undetermined_Index", "Count", "Fraction", "Sample_Project", "Lane_Project", "index1", "index2", copies).drop("one")


def unexpected(hits: DataFrame, sheet: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Hits whose indexes the sheet doesn't expect in their own lane; those without second index always stay."""
    keys = [*(run or []), "Lane", "index1", "index2"]
    return hits.join(sheet.select(keys).distinct(), keys, "left_anti").select(hits.columns)


def by_barcode(hits: DataFrame) -> DataFrame:
    """One row for each lane and barcode: the largest count with its fraction, projects and their lanes as sorted lists."""
    top = F.max(F.struct("Count", "Fraction"))
    both = F.array_sort(F.collect_list(F.struct("Sample_Project", "Lane_Project")))
    return (
        hits.groupBy("Lane", "Undetermined_Index").agg(top.alias("top"), both.alias("both"))
        .select("Lane", "Undetermined_Index", "top.Count", "top.Fraction", F.col("both.Sample_Project").alias("Sample_Project"), F.col("both.Lane_Project").alias("Lane_Project"))
    )


def by_lane(hits: DataFrame) -> DataFrame:
    """Reads and shares of each lane's distinct barcodes."""
    top = hits.groupBy("Lane", "Undetermined_Index").agg(F.max(F.struct("Count", "Fraction")).alias("top"))
    return top.groupBy("Lane").agg(F.sum("top.Count").alias("Lane_Count"), F.sum("top.Fraction").alias("Lane_Fraction"))


def undetermined(reads: DataFrame, strict: bool = True) -> DataFrame:
    """Reads as the barcode operators take them: file, Lane, Undetermined_Index, pos. A name without barcode raises, or has a null one if not strict."""
    from lanewise.functions import names

    return reads.select("file", names.lane_of_file(F.col("file")).alias("Lane"), names.barcode(F.col("name"), strict).alias("Undetermined_Index"), "pos")
