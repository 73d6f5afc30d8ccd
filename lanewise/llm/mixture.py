"""Mixing sources to target weights, by cube-method balanced sampling."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.bpe import count_tokens
from lanewise.runtime import checkpointed

#: Targets that may be given at most; the list is kept on the driver and broadcast.
MOST_TARGETS = 10_000
NEAR = 1e-9
#: Documents of a source that are balanced together in a task.
BUCKET_ROWS = 100_000
#: Times the mean size from which a document is decided against the tokens of all others.
HEAVY = 4

Unit = list  # [position, tokens, probability]


def move(active: list[Unit], rng: random.Random, balance_tokens: bool = True) -> list[Unit]:
    """One step of the flight: along the null space of the constraints until a probability is 0 or 1.

    Within a source all first probabilities are equal, so the constraint columns are (1, tokens)
    and three units leave a line: u = (t2 - t3, t3 - t1, t1 - t2). Returns the decided units.
    """
    if balance_tokens and len(active) == 3:
        a, b, c = (x[1] for x in active)
        u = (b - c, c - a, a - b)
        if not any(u):
            u = (1, -1, 0)
    else:
        u = (1, -1, *[0] * (len(active) - 2))
    up = min((1 - x[2]) / v if v > 0 else -x[2] / v for x, v in zip(active, u) if v)
    down = min(x[2] / v if v > 0 else (x[2] - 1) / v for x, v in zip(active, u) if v)
    step = up if rng.random() * (up + down) < down else -down
    for x, v in zip(active, u):
        x[2] = x[2] + step * v
    done = [x for x in active if not NEAR < x[2] < 1 - NEAR]
    if not done:  # rounding: the nearest one has arrived
        done = [min(active, key=lambda x: min(x[2], 1 - x[2]))]
    for x in done:
        x[2] = float(round(x[2]))
        active.remove(x)
    return done


def flight(units: Iterable[Unit], rng: random.Random, active: list[Unit]) -> Iterator[Unit]:
    """Decides all but at most two of the units, which stay in ``active``; constant memory."""
    for unit in units:
        if not NEAR < unit[2] < 1 - NEAR:
            unit[2] = float(round(unit[2]))
            yield unit
            continue
        active.append(unit)
        while len(active) == 3:
            yield from move(active, rng)


def landing(active: list[Unit], rng: random.Random) -> Iterator[Unit]:
    """The last units: the token constraint is dropped, then the one on the number of documents."""
    while len(active) > 1:
        yield from move(active, rng, balance_tokens=False)
    for unit in active:
        unit[2] = float(rng.random() < unit[2])
        yield unit


def descend(tokens: list[int], chance: float, rng: random.Random) -> list[float]:
    """Probabilities of units of equal ``chance``, largest first, moved until they are 0 or 1 as far as the constraints allow.

    A unit is moved to 0 or 1 against all that follow, which share the move. Units of more than
    HEAVY times the mean come first, and the probabilities of the rest change by the same number
    so that the sum of tokens stays. Behind them those of the rest are alpha + beta * tokens, so
    that both sums stay. Every move keeps all expectations. It ends where one of the rest would
    leave 0 to 1: those are the smallest, and few.
    """
    out, size = [chance] * len(tokens), len(tokens)
    n, one, two = float(size), float(sum(tokens)), float(sum(x * x for x in tokens))
    heavy = sum(t * n > HEAVY * one for t in tokens)
    docs, total, least = chance * n, chance * one, tokens[-1] if tokens else 0
    alpha, beta, both, at = chance, 0.0, False, 0

    def fitted(docs: float, total: float, n: float, one: float, two: float, most: int) -> tuple[float, float] | None:
        """alpha and beta for so many documents and tokens out of the rest, None if one would leave 0 to 1."""
        if not both:
            x, y = (total / one, 0.0) if one else (-1.0, 0.0)
        elif (whole := n * two - one * one) > 1e-9 * n * two:
            x, y = (docs * two - total * one) / whole, (total * n - docs * one) / whole
        else:
            return None
        return (x, y) if 0 <= x + y * least <= 1 and 0 <= x + y * most <= 1 else None

    for at, (t, most) in enumerate(pairwise(tokens)):
        if at == heavy:  # from here on the number of documents is kept too
            both, docs = True, alpha * n
        n, one, two = n - 1, one - t, two - t * t
        with_it, without = fitted(docs - 1, total - t, n, one, two, most), fitted(docs, total, n, one, two, most)
        if not with_it or not without:
            break
        taken = rng.random() < alpha + beta * t
        out[at] = float(taken)
        docs, total = docs - taken, total - t * taken
        alpha, beta = with_it if taken else without
    else:
        at = max(0, size - 1)
    for i in range(at, size):
        out[i] = min(1.0, max(0.0, alpha + beta * tokens[i]))
    return out


def balance(seed: int, schema: str):
    """Moves the documents of a source and bucket; leaves at most two undecided, none in the last round."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "order", "id"], ascending=[False, True, True], ignore_index=True)
        rng = random.Random(f"{seed} {frame['source'].iloc[0]} {frame['bucket'].iloc[0]} {frame['round'].iloc[0]}")
        tokens, chance = frame["tokens"].tolist(), frame["chance"].tolist()
        if frame["round"].iloc[0] == 0:  # later ones differ
            chance = descend(tokens, chance[0], rng)
        active: list[Unit] = []
        done = list(flight(([i, t, p] for i, (t, p) in enumerate(zip(tokens, chance))), rng, active))
        done += landing(active, rng) if frame["last"].iloc[0] else active
        for i, _, p in done:
            chance[i] = p
        return frame.assign(chance=chance)

    return task


def rounds(rows: int, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """Buckets of a source in each round: what a round leaves is at most two of each bucket; the last has one."""
    out = [max(1, -(-rows // bucket_rows))]
    while out[-1] > 1:
        out.append(-(-2 * out[-1] // bucket_rows))
    return out


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Times that each source is used: the target share of the largest size that all caps allow.

    Sources without tokens can't contribute; the weights of the others then hold relative to
    each other. With ``total``, sources are used up to their cap and may fall short.
    """
    there = {s: w for s, (w, _) in targets.items() if available.get(s) and w > 0}
    whole = sum(there.values())
    if not there:
        return {}
    size = total if total is not None else min(available[s] * targets[s][1] * whole / w for s, w in there.items())
    return {s: min(float(targets[s][1]), size * w / whole / available[s]) for s, w in there.items()}


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    given = targets.select("source", "weight", "max_repeats").limit(MOST_TARGETS + 1).collect()
    if len(given) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out = {r["source"]: (float(r["weight"] or 0), int(r["max_repeats"] or 0)) for r in given if r["source"] is not None}
    if len(out) != sum(r["source"] is not None for r in given):
        raise ValueError("a source has several targets")
    if any(w < 0 or m < 0 for w, m in out.values()):
        raise ValueError("weights and repeats can't be below 0")
    return out


def mix(docs: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, vocabulary: str | None = None, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The mixture (``id``, ``source``, ``tokens``, ``copies``) and the report of shares by source.

    A source is used ``q`` times on average: every document ``floor(q)`` times and once more
    with the probability ``q - floor(q)``, drawn by the cube method so that the number of
    documents and the sum of tokens of each source come out as planned, but for the last
    document or two. No document is used more than ``max_repeats`` times. ``q`` is the largest
    for which every source that has tokens meets its weight (see ``plan``), or what ``total``
    tokens need; the report tells the ``tokens_planned`` and by ``binding`` the sources whose cap sets the size. Documents
    with a null source or one without target take no part; a null or empty text has 0 tokens;
    repeated rows are documents of their own; a source or table without rows gives a share of
    0. Other columns of ``docs`` are ignored.

    Texts are read once, in tasks that shuffle nothing; what follows works on a written table
    of (id, source, tokens). A source's documents are hashed into buckets of about
    ``bucket_rows``, so that a hot source is spread over tasks; within each the largest are
    decided first. What the buckets leave, two of their smallest at most, meets in fewer buckets
    in the next round. Random numbers depend on source and bucket, and order on tokens and
    hashed ids, so the mixture is the same however the files are split.
    """
    wanted = read_targets(targets)
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    sized = checkpointed(count_tokens(named.filter(F.col("source").isin(list(wanted))), ["id", "source"], vocabulary=vocabulary))
    had = {r["source"]: (r["n"], r["t"], r["m"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("m")).collect()}
    available = {s: t for s, (_, t, _) in had.items()}
    times = plan(available, wanted, total)
    parts = []
    for s, q in times.items():
        base = min(math.floor(q + NEAR), wanted[s][1])
        parts.append((s, base, max(0.0, q - base) if base < wanted[s][1] else 0.0, rounds(had[s][0], bucket_rows)))
    use = spark.createDataFrame(parts, "source string, base bigint, chance double, rounds array<bigint>")
    order = F.xxhash64(F.lit(seed), "id", "tokens")
    rows = sized.join(F.broadcast(use), "source").withColumn("order", order)
    open_ = (F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)
    decided, columns = rows.filter(~open_), ["id", "source", "tokens", "base", "chance"]
    done, left = [decided.select(columns)], rows.filter(open_)
    for n in range(max((len(p[3]) for p in parts), default=0)):
        placed = left.withColumns({
            "round": F.lit(n), "bucket": F.pmod(F.xxhash64("order", F.lit(n)), F.get("rounds", F.lit(n))), "last": F.size("rounds") == n + 1})
        schema = ", ".join(f"{c} {k}" for c, k in placed.dtypes)
        flown = checkpointed(placed.groupBy("source", "bucket").applyInPandas(balance(seed, schema), schema))
        done.append(flown.filter(~open_).select(columns))
        left = flown.filter(open_).drop("round", "bucket", "last")
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    copies = F.col("base") + F.round("chance").cast("bigint")
    mixture = all_rows.withColumn("copies", copies).filter(F.col("copies") > 0).select(F.col("id").alias(id), F.col("source").alias(source), "tokens", "copies")
    used = mixture.groupBy(F.col(source).alias("source")).agg(
        F.sum("copies").alias("documents_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    whole = sum(w for s, (w, _) in wanted.items() if s in times)
    binding = {s for s, q in times.items() if q >= wanted[s][1] * (1 - NEAR)}
    base = spark.createDataFrame(
        [(s, w, m, *had.get(s, (0, 0, 0)), times.get(s, 0.0) * available.get(s, 0), w / whole if s in times else 0.0, s in binding) for s, (w, m) in sorted(wanted.items())],
        "source string, weight double, max_repeats int, documents bigint, tokens bigint, largest bigint, tokens_planned double, attainable_share double, binding boolean",
    )
    filled = base.join(used, "source", "left").na.fill(0, ["documents_used", "tokens_used", "most_copies"])
    all_used = used.agg(F.sum("tokens_used").alias("all_tokens")).withColumn("one", F.lit(1))
    shares = (
        filled.withColumn("one", F.lit(1)).join(F.broadcast(all_used), "one")
        .withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("tokens_used") / F.col("all_tokens")).otherwise(F.lit(0.0)))
        .drop("one", "all_tokens")
    )
    return mixture, shares
