"""Cycle masks such as ``U8Y143;I10;I10;Y151``."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIELDS = ("U1", "R1B", "R1", "R1A", "I1B", "I1", "I1A", "U2", "I2B", "I2", "I2A", "R2B", "R2", "R2A")
MOST_SEGMENTS = 4


def parse_mask(mask: Column) -> Column:
    """Struct of the fourteen cycle numbers of a mask, all INT; null for a null mask.

    Segments 1 and 2 belong to read and index 1, 3 and 4 to read and index 2; a segment with a
    ``Y`` is a read, else an index. ``Y`` and ``I`` set the cycles of the segment, other letters
    those before it while they are 0, then those after it; ``U`` sets the first umi, and the
    second once the first is set. Later values replace earlier ones; more than four segments raise.
    """
    segments = F.split(F.upper(mask), ";")

    def pairs(segment: Column, s: Column) -> Column:
        kind = F.concat(F.when(segment.contains("Y"), "R").otherwise("I"), (F.floor(s / 2) + 1).cast("string"))
        found = F.regexp_extract_all(segment, F.lit("([A-Z]+[0-9]+)"), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.regexp_extract(t, "^([A-Z]+)", 1).alias("letter"), F.regexp_extract(t, "([0-9]+)$", 1).cast("int").alias("n"), kind.alias("kind")))

    def step(state: Column, pair: Column) -> Column:
        letter, n = pair["letter"], pair["n"]
        umi, own = letter == "U", letter.isin("Y", "I")
        new = {"U1": umi & (state["U1"] == 0), "U2": umi & (state["U1"] != 0)}
        for main in ("R1", "I1", "I2", "R2"):
            here = (pair["kind"] == main) & ~umi
            new |= {main: here & own, f"{main}B": here & ~own & (state[main] == 0), f"{main}A": here & ~own & (state[main] != 0)}
        return F.struct(*[F.when(new[f], n).otherwise(state[f]).alias(f) for f in FIELDS])

    whole = F.aggregate(F.flatten(F.transform(segments, pairs)), F.struct(*[F.lit(0).alias(f) for f in FIELDS]), step)
    return F.when(F.size(segments) > MOST_SEGMENTS, F.raise_error(F.concat(F.lit("mask of more than four parts: "), mask))).when(mask.isNotNull(), whole)


def parsed(spark: SparkSession, mask: str) -> dict[str, int]:
    """The cycle numbers of one mask, for options of the command line."""
    if mask.count(";") >= MOST_SEGMENTS:
        raise ValueError(f"mask of more than four parts: {mask}")
    return spark.range(1).select(parse_mask(F.lit(mask)).alias("m")).first()["m"].asDict()


def fits(index: Column, cycles: Column) -> Column:
    """Whether an index (null: empty) has the length that the mask names."""
    return F.length(F.coalesce(index, F.lit(""))) == cycles


def checked(index: Column, cycles: Column, what: str) -> Column:
    """The index, or an error naming it if its length isn't the mask's."""
    text = F.coalesce(index, F.lit(""))
    return F.when(F.length(text) == cycles, text).otherwise(F.raise_error(F.concat(F.lit(f"{what} doesn't have the length of its mask: "), text)))


def padded(before: Column, text: Column, after: Column) -> Column:
    return F.concat(F.repeat(F.lit("N"), before), text, F.repeat(F.lit("N"), after))
