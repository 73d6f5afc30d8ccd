"""Queries of the training-data operators, over the whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import bpe, heavy, mixture, repetition, reservoir, topn
from lanewise.runtime import table

#: Rows of the sample; of the small ones, which no table is too small for; batches that feed a reservoir.
SAMPLE, SMALL, ARRIVALS = 20_000, 500, 8


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_ranked(spark, sf_dir).select("run_id", "Lane", "Undetermined_Index")


def p2_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_items(table(spark, sf_dir, "mixing_results"), ["run_id", "Lane"], "Undetermined_Index", "Count", 5)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.reservoir_sample(table(spark, sf_dir, "reads"), SAMPLE, "chunk_id", "read_id")


def p3_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of a reservoir that is fed with the pieces, by ``chunk_id``, in several batches one after the other."""
    reads = table(spark, sf_dir, "reads")
    piece = F.coalesce("chunk_id", F.lit(-1))
    low, high = reads.agg(F.min(piece), F.max(piece)).first()
    state, sample = reservoir.Reservoir(SMALL, "read_id"), reads.limit(0)
    for i in range(ARRIVALS if low is not None else 0):
        begin, end = (low + (high + 1 - low) * n // ARRIVALS for n in (i, i + 1))
        sample = state.add(reads.filter((piece >= begin) & (piece < end)))
    return sample


def p3_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a small sample of the table at rest and of the fed one: its size, no row twice, only rows of the table with all their values, and as many of each half of the pieces as chance allows."""
    reads = table(spark, sf_dir, "reads")
    size = reads.count()
    early = F.coalesce("chunk_id", F.lit(-1)) <= reads.agg(F.percentile_approx(F.coalesce("chunk_id", F.lit(-1)), 0.5)).first()[0] if size else F.lit(False)
    first = reads.filter(early).count()
    out = None
    for name, sample in (("rest", reservoir.reservoir_sample(reads, SMALL, "chunk_id", "read_id")), ("fed", p3_arrivals(spark, sf_dir))):
        n = F.count("*")
        part = F.lit(first / max(1, size))
        off = F.abs(F.sum(early.cast("int")) - n * part) <= 5 * F.sqrt(n * part * (1 - part)) + 1
        row = sample.agg(F.lit(name).alias("sample"), n.alias("rows"), (F.countDistinct("read_id") == n).alias("once"), off.alias("even"))
        known = sample.join(reads, [F.equal_null(sample[c], reads[c]) for c in reads.columns], "left_semi").agg(F.count("*").alias("known"))
        row = row.withColumn("known", F.lit(known.first()[0]))
        out = row if out is None else out.unionByName(row)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heavy(spark, sf_dir).select("Undetermined_Index")


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy.heavy_items(table(spark, sf_dir, "mixing_results"), "Undetermined_Index", "Count", 0.01)


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals as verified, and whether the sketch's estimate is at least that and within its bound.

    A row of the sketch errs by more than e / 1024 of all counts with a chance of 1 / e, the least of four
    rows with e ** -4; all counts are at most 100 times an item's total here.
    """
    close = (F.col("estimate") >= F.col("total")) & (F.col("estimate") <= F.col("total") * (1 + 100 * math.e / heavy.WIDTH))
    return _heavy(spark, sf_dir).select("Undetermined_Index", "total", close.alias("close"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), ["doc_id"])


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode_corpus(p6_ids(spark, sf_dir), ["doc_id"])


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps its cap, meets the planned tokens but for a document at most, and has no document twice."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mixture_, shares = mixture.mix(docs, targets)
    once = mixture_.groupBy("source").agg((F.countDistinct("doc_id") == F.count("*")).alias("once"))
    near = F.abs(F.col("tokens_used") - F.col("tokens_planned")) <= F.col("largest")
    return shares.join(once, "source", "left").select("source", "documents", F.coalesce("once", F.lit(True)).alias("once"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), near.alias("near"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repetition(spark, sf_dir).filter("repetitive").select("doc_id")


def _repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact share of every document."""
    rows = repetition.measure(table(spark, sf_dir, "documents"), ["doc_id"])
    share = F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(0.0)
    return rows.withColumn("share", F.round(share, 9))


def p8_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repetition(spark, sf_dir).select("doc_id", "llr", "candidate", "repetitive")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_ranked, p3_sample, p3_arrivals, p3_even, p4_found, p4_totals, p6_ids, p6_decoded, p7_mixture, p7_shares, p7_kept, p8_found, p8_shares, p8_ratios)}
