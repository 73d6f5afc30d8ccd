"""Most frequent items in bounded memory, by combinatorial group testing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 64
WIDTH = 1024
DEPTH = 4
#: Rows of which a task keeps a copy before it adds them to its counters.
BLOCK = 65_536
#: Odd multipliers of the rows' bucket hashes; any odd 64-bit numbers serve.
MULTIPLIERS = tuple((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 17))


def buckets(prints: np.ndarray, row: int, width: int, seed: int) -> np.ndarray:
    """The bucket of each 64-bit fingerprint in a row of the sketch."""
    h = (prints.astype(np.uint64) ^ np.uint64(seed * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * np.uint64(MULTIPLIERS[row % len(MULTIPLIERS)])
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(width)).astype(np.int64)


def sums(cells: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
    """Exact int64 sums by cell: a float64 bincount of each 26-bit part of the weights."""
    out = np.zeros(width, np.int64)
    shift = 0
    rest = weights
    while True:
        out += np.bincount(cells, weights=(rest & 0x3FFFFFF).astype(np.float64), minlength=width).astype(np.int64) << shift
        rest = rest >> 26
        shift += 26
        if not rest.any():
            return out


class Sketch:
    """``depth`` rows of ``width`` buckets, each with a total and one counter per fingerprint bit."""

    def __init__(self, width: int, depth: int, seed: int):
        self.width, self.depth, self.seed = width, depth, seed
        self.cells = np.zeros((depth, BITS + 1, width), np.int64)

    def add(self, prints: np.ndarray, weights: np.ndarray) -> None:
        prints, inverse = np.unique(prints, return_inverse=True)
        weights = sums(inverse, weights, len(prints))
        ones = [((prints.astype(np.uint64) >> np.uint64(b)) & np.uint64(1)).astype(bool) for b in range(BITS)]
        for row in range(self.depth):
            at = buckets(prints, row, self.width, self.seed)
            self.cells[row, 0] += sums(at, weights, self.width)
            for b, on in enumerate(ones):
                self.cells[row, b + 1] += sums(at[on], weights[on], self.width)


def decode(cells: np.ndarray, least: int) -> set[int]:
    """Fingerprints that own at least ``least`` of a bucket in which no other bit pattern does.

    A bucket dominated by one item shows, for every bit, at least ``least`` on the item's side
    and less on the other; a bucket with both sides heavy is left to the other rows.
    """
    found: set[int] = set()
    for row in cells:
        for at in np.flatnonzero(row[0] >= least):
            one = row[1:, at]
            zero = row[0, at] - one
            if ((one >= least) != (zero >= least)).all():
                found.add(sum(1 << b for b in range(BITS) if one[b] >= least))
    return found


def build_sketch(prints: DataFrame, width: int, depth: int, seed: int) -> np.ndarray:
    """The sketch of ``prints`` (fingerprint long, weight long), built by task and added up by Spark.

    A task sends at most ``width * depth`` rows of 66 numbers, however many items it saw, and
    the driver gets one sketch: both are fixed by the parameters, not by the data.
    """
    names = ["cell", *[f"c{i}" for i in range(BITS + 1)]]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, depth, seed)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> None:
            if held:
                sketch.add(np.concatenate([p for p, _ in held]), np.concatenate([w for _, w in held]))
                held.clear()

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= BLOCK:
                flush()
                rows = 0
        flush()
        flat = sketch.cells.transpose(0, 2, 1).reshape(width * depth, BITS + 1)
        used = np.flatnonzero(flat[:, 0])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(np.ascontiguousarray(flat[used, i])) for i in range(BITS + 1)]], schema=schema)

    parts = prints.mapInArrow(task, ", ".join(f"{n} bigint" for n in names))
    total = parts.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow()
    flat = np.zeros((width * depth, BITS + 1), np.int64)
    if total.num_rows:
        flat[total.column(0).to_numpy()] = np.stack([total.column(i + 1).to_numpy() for i in range(BITS + 1)], axis=1)
    return np.ascontiguousarray(flat.reshape(depth, width, BITS + 1).transpose(0, 2, 1))


def complete(cells: np.ndarray, verified: list[tuple[int, int]], least: int, width: int, seed: int) -> bool:
    """True if no item of at least ``least`` can be missing from ``verified`` (fingerprint, total).

    What is left of a bucket without the verified items can only hold such an item if every bit
    has that much on one of its sides. A missing item would do so in its bucket of every row,
    so a row without such a bucket proves that none is missing.
    """
    prints = np.array([p for p, _ in verified], np.uint64)
    totals = np.array([t for _, t in verified], np.int64)
    for row in range(len(cells)):
        rest = cells[row].copy()
        if len(prints):
            at = buckets(prints, row, width, seed)
            rest[0] -= sums(at, totals, width)
            for b in range(BITS):
                on = (prints >> np.uint64(b)) & np.uint64(1) == 1
                rest[b + 1] -= sums(at[on], totals[on], width)
        larger = np.maximum(rest[1:], rest[0] - rest[1:])
        if not (larger >= least).all(axis=0).any():
            return True
    return False


def heavy_items(df: DataFrame, item: str, weight: str | None = None, share: float = 0.01, width: int = WIDTH, depth: int = DEPTH, seed: int = 7) -> DataFrame:
    """Items that hold at least ``share`` of the whole weight: ``item``, ``estimate``, ``total``.

    ``estimate`` is the sketch's upper bound (the smallest of the item's buckets), ``total``
    the exact sum from the verifying pass. ``weight`` is a column of whole numbers, 1 per row
    if None. Rows with a null item take no part, a null weight adds nothing; repeated rows
    count each time. A weight below 0 raises; an empty table, or one whose weights sum to 0,
    gives no rows. Other columns are ignored, whatever their names.

    Pass 1 adds one sketch per task; buckets are decoded into candidate fingerprints on the
    driver (at most ``depth / share``). Pass 2 sums the rows of the candidates only and drops
    those below the share, so a fingerprint shared by two items can't make a false result.
    ``complete`` then proves that none was missed; otherwise both passes run again with other
    hashes and twice the width, up to a width of ``2 ** 6`` times the first.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    value = F.col(f"`{item}`")
    amount = F.coalesce(F.col(f"`{weight}`").cast("bigint"), F.lit(0).cast("bigint")) if weight else F.lit(1).cast("bigint")
    rows = df.filter(value.isNotNull()).select(
        value.alias("item"),
        F.xxhash64(value).alias("print"),
        F.when(amount < 0, F.raise_error(F.lit("a weight is below 0"))).otherwise(amount).cast("bigint").alias("weight"),
    )
    spark = df.sparkSession
    for attempt in range(7):
        cells = build_sketch(rows.select("print", "weight"), width << attempt, depth, seed + attempt)
        whole = int(cells[0, 0].sum())
        least = max(1, math.ceil(Fraction(str(share)) * whole))
        signed = [p - (1 << 64) if p >> 63 else p for p in decode(cells, least)]
        if not whole or not signed:
            found = []
        else:
            at = np.array(signed, np.int64).astype(np.uint64)
            bound = np.min([cells[r, 0][buckets(at, r, width << attempt, seed + attempt)] for r in range(depth)], axis=0)
            wanted = dict(zip(signed, map(int, bound)))
            sums_ = rows.filter(F.col("print").isin(signed)).groupBy("item", "print").agg(F.sum("weight").alias("total"))
            found = [(r["item"], wanted[r["print"]], r["total"], r["print"]) for r in sums_.collect()]
        if not whole or complete(cells, [(p & 0xFFFFFFFFFFFFFFFF, t) for _, _, t, p in found], least, width << attempt, seed + attempt):
            break
    else:
        raise RuntimeError("the sketch couldn't be decoded; raise width")
    kept = [(i, e, t) for i, e, t, _ in found if t >= least]
    kind = dict(df.dtypes)[item]
    return spark.createDataFrame(kept, f"item {kind}, estimate bigint, total bigint").withColumnRenamed("item", item)
