"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_items(df: DataFrame, group: list[str], item: str, score: str, n: int = 5, salts: int = SALTS) -> DataFrame:
    """The ``n`` best items of each group, one row per (group, item): ``group``, ``item``, ``score``, ``rank``.

    An item's score is the largest ``score`` of its rows in the group. Equal scores rank by
    ``item``, the smaller first (byte order for strings), so the result never depends on the
    order of rows. Rows with a null in a group column, the item or the score take no part;
    repeated rows count once; an empty table gives an empty result. Other columns of ``df``
    are ignored, whatever their names.

    Plan: (1) ``max`` by (group, item), combined map-side, so a hot item or group reaches the
    shuffle as one row per task; (2) items hashed into ``salts`` subgroups, the best ``n`` of
    each kept - the rank filter is pushed below that exchange as a window group limit, so a
    group with millions of items sends at most ``n`` rows per task and subgroup; (3) at most
    ``n * salts`` survivors of a group ranked in one task.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be at least 1")
    keys = [f"g{i}" for i in range(len(group))]
    rows = df.select(
        *[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)],
        F.col(f"`{item}`").alias("item"),
        F.col(f"`{score}`").alias("score"),
    ).na.drop()
    best = rows.groupBy(*keys, "item").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("item").asc()]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    survivors = (
        salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order)))
        .filter(F.col("place") <= n)
        .drop("place", "salt")
    )
    ranked = survivors.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("item").alias(item), F.col("score").alias(score), "rank")
