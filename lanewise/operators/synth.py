"""Synthetic reads and flowcells, the same for the same seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import names
from lanewise.schema import ORIGIN, SURFACES, SWATHS, TILES

X_RANGE, Y_RANGE = 2201, 601


def letters(alphabet: str) -> str:
    return "".join(sorted(set(alphabet.upper())))


def scattered(value: Column, size: int, seed: int) -> Column:
    """A permutation of 0 .. size - 1: an affine step that shares no factor with ``size``."""
    if size >= 1 << 53:
        raise ValueError("too many rows")
    step = max(1, min(int(size * 0.6180339887), (1 << 62) // size)) + seed % 7
    while math.gcd(step, size) != 1:
        step += 1
    return F.pmod(F.pmod(value, F.lit(size)) * F.lit(step % size or 1) + F.lit(seed % size), F.lit(size))


def sequences(spark: SparkSession, number: int, length: int, alphabet: str = "ACGT", seed: int = 0) -> DataFrame:
    """``number`` different sequences (``id`` from 0, ``sequence``); ValueError if there aren't so many.

    The first letters write a permuted row number in the alphabet's base, which keeps them
    apart without a distinct; hashes of seed, row and place choose the others.
    """
    alpha = letters(alphabet)
    k = len(alpha)
    if number > k**length:
        raise ValueError(f"there are only {k**length} sequences of {length} out of {k} letters")
    places = 0
    while k**places < number:
        places += 1
    pick = lambda n: F.substr(F.lit(alpha), (n + 1).cast("int"), F.lit(1))
    code = scattered(F.col("id"), k**places, seed) if places else F.lit(0)
    head = [pick(F.pmod(F.floor(code / F.lit(k**p)), F.lit(k))) for p in range(places)]
    rest = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(max(1, length - places))), lambda i: pick(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(k)))), "")
    return spark.range(number).select("id", F.concat(*head, rest if length > places else F.lit("")).alias("sequence"))


def positions(ids: DataFrame, number: int, seed: int = 0) -> DataFrame:
    """``x``, ``y`` of rows 0 .. number - 1: the product of as many different columns and rows; ValueError above 601 of either."""
    side = math.ceil(math.sqrt(number))
    if side > Y_RANGE:
        raise ValueError(f"a tile has room for {Y_RANGE**2} reads")
    x = scattered(F.floor(F.col("id") / side).cast("bigint"), X_RANGE, seed) + ORIGIN
    y = scattered(F.pmod("id", F.lit(side)).cast("bigint"), Y_RANGE, seed) + ORIGIN
    return ids.withColumns({"x": x, "y": y})


def all_tiles(spark: SparkSession) -> DataFrame:
    """``no`` from 0 and ``tile``: the tiles of a lane."""
    n = F.col("id")
    tile = (F.floor(n / (SWATHS * TILES)) + 1) * 1000 + (F.pmod(F.floor(n / TILES), F.lit(SWATHS)) + 1) * 100 + F.pmod(n, F.lit(TILES)) + 1
    return spark.range(SURFACES * SWATHS * TILES).select(n.alias("no"), tile.cast("bigint").alias("tile"))


def sample_tiles(samples: DataFrame, tiles: int = SURFACES * SWATHS * TILES) -> DataFrame:
    """A tile of its own for each sample (``n`` from 0): the last of its part, when all are split into nearly equal parts in order."""
    total = F.lit(samples.count())
    size, longer = F.floor(F.lit(tiles) / total), F.pmod(F.lit(tiles), total)
    return samples.withColumn("tile_no", ((F.col("n") + 1) * size + F.least(F.col("n") + 1, longer) - 1).cast("bigint"))


def flowcell_id(seed: int) -> str:
    """Two digits, six letters and a digit."""
    import random

    rng = random.Random(seed)
    return f"{rng.randint(10, 99)}" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(6)) + str(rng.randint(0, 9))


def flowcell_name(day: Column, instrument: Column, run: Column, flowcell: Column) -> Column:
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), instrument, F.lit("_"), names.left_pad(run.cast("string"), 4, "0"), F.lit("_A"), flowcell)


def hashed(length: Column, alphabet: str, *keys: Column) -> Column:
    """A sequence of ``length`` letters chosen by hashes of the keys and the place; empty for 0."""
    alpha = letters(alphabet)
    place = lambda i: F.substr(F.lit(alpha), (F.pmod(F.xxhash64(*keys, i), F.lit(len(alpha))) + 1).cast("int"), F.lit(1))
    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), place), "")).otherwise("")


def sample_reads(samples: DataFrame, number: int, alphabet: str = "ACGT", seed: int = 0) -> DataFrame:
    """``number`` clusters of each sample, a row for each mate that its recipe has.

    ``samples``: n, prefix (of the read names, without tile), tile, extension, and R1, R2, U1,
    U2 (cycles). Result: n, pos, mate, name, sequence, quality.
    """
    side = F.lit(math.ceil(math.sqrt(number)))
    if math.ceil(math.sqrt(number)) > Y_RANGE:
        raise ValueError(f"a tile has room for {Y_RANGE**2} reads")
    mates = F.filter(F.array(F.lit(1), F.lit(2)), lambda m: F.when(m == 1, F.col("R1")).otherwise(F.col("R2")) > 0)
    rows = samples.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint")))).withColumn("mate", F.explode(mates))
    x = scattered(F.floor(F.col("pos") / side).cast("bigint"), X_RANGE, seed) + ORIGIN
    y = scattered(F.pmod("pos", side).cast("bigint"), Y_RANGE, seed) + ORIGIN
    key = [F.lit(seed), F.col("n"), F.col("pos")]
    umi = [hashed(F.col(u), alphabet, *key, F.lit(u)) for u in ("U1", "U2")]
    umis = F.when((F.col("U1") > 0) | (F.col("U2") > 0), F.concat(F.lit(":"), F.concat_ws("+", *[F.nullif(u, F.lit("")) for u in umi]))).otherwise("")
    end = F.when(F.col("mate") == 2, F.regexp_replace("extension", "^ 1", " 2")).otherwise(F.col("extension"))
    name = F.concat("prefix", F.lit(":"), F.col("tile").cast("string"), F.lit(":"), x.cast("string"), F.lit(":"), y.cast("string"), umis, end)
    length = F.when(F.col("mate") == 1, F.col("R1")).otherwise(F.col("R2"))
    sequence = hashed(length, alphabet, *key, F.col("mate"))
    return rows.select("n", "pos", "mate", name.alias("name"), sequence.alias("sequence"), F.repeat(F.lit("I"), length).alias("quality"))


def sample_paths(samples: DataFrame) -> DataFrame:
    """``path`` of each sample's files (Sample_Project, Sample_ID, number, Lane, reads) in the flowcell's folder."""
    short = F.regexp_replace("Sample_ID", "^Sample_", "")
    last = F.concat(short, F.lit("_S"), F.col("number").cast("string"), F.lit("_"), names.lane_name(F.col("Lane")), F.lit("_R"), F.col("mate").cast("string"), F.lit("_001.fastq.gz"))
    rows = samples.withColumn("mate", F.explode(F.sequence(F.lit(1), F.col("reads"))))
    return rows.select("number", "mate", F.concat_ws("/", F.lit("Demultiplexing"), "Sample_Project", "Sample_ID", last).alias("path"))
