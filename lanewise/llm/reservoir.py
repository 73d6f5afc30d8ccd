"""Fixed-size uniform sample of data that arrives in pieces: a distributed reservoir."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.runtime import checkpointed, fresh_name, written

#: Rows of the sample that a slot holds; there are as many slots as the sample needs.
SLOT_ROWS = 50_000
#: Pieces whose counts the driver takes at most, 16 bytes each; ``Reservoir`` needs none of them.
MOST_PIECES = 16_000_000
#: Written parts of a reservoir before what has been evicted is left behind.
MOST_PARTS = 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Of ``draws`` taken without replacement from ``good + bad``, how many are good.

    By inversion, at any size alike: the chances around the most likely number, up to 14
    deviations off it, follow from the ratios of neighbours. Memory grows with the root of ``draws``.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    likely = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(14 * math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)))) + 60
    first, last = max(low, likely - spread), min(high, likely + spread)
    x = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(chance - chance.max()))
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right").clip(0, last - first))


def split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """``draws`` without replacement split over groups of these sizes."""
    out = np.zeros(len(sizes), np.int64)
    rest = int(sizes.sum())
    for i, n in enumerate(map(int, sizes)):
        if not draws:
            break
        rest -= n
        out[i] = hypergeometric(rng, n, rest, draws)
        draws -= int(out[i])
    return out


def survivors(counts: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of each (batch, slot) that are in the reservoir after the last batch.

    Forwards, each batch draws its hypergeometric replacement count; that many rows are evicted,
    split over the slots by their sizes, and as many of the batch inserted, split by where its
    rows hash to. Backwards, each slot's final rows are traced: all that the last batch inserted
    stay, the others are a uniform part of what the slot held before.
    """
    batches, slots = counts.shape
    held = np.zeros(slots, np.int64)
    before = np.zeros((batches, slots), np.int64)  # after eviction
    inserted = np.zeros((batches, slots), np.int64)
    seen = 0
    for t in range(batches):
        n, size = int(counts[t].sum()), int(held.sum())
        full = min(k, seen + n)
        new = hypergeometric(rng, n, seen, full)
        before[t] = held - split(rng, held, size + new - full)
        inserted[t] = split(rng, counts[t], new)
        held = before[t] + inserted[t]
        seen += n
    out = np.zeros((batches, slots), np.int64)
    alive = held.copy()  # of the rows held after batch t, how many are there at the end
    for t in range(batches - 1, -1, -1):
        for s in range(slots):
            # a uniform part, of size alive[s], of before + inserted
            out[t, s] = hypergeometric(rng, int(inserted[t, s]), int(before[t, s]), int(alive[s]))
        alive = alive - out[t]
    return out


def slots_for(k: int) -> int:
    return max(1, -(-k // SLOT_ROWS))


def reservoir_sample(df: DataFrame, k: int, piece: str, id: str, slots: int | None = None, seed: int = 5, headroom: float = 6.0) -> DataFrame:
    """A uniform sample of ``k`` rows of ``df`` (all, if there are fewer), with all its columns.

    The arrivals of a table at rest: pieces arrive in the order of ``piece`` (whole numbers; rows
    with a null piece come first), each as a batch of its own; every row is equally likely, and
    so is every set of ``k`` rows. ``id`` tells rows apart: a row's place within its slot is a
    seeded hash of it, so the sample is the same however the files are split or tasks run
    again. Rows that share an id, or have none, are placed by their other values too; rows that
    are alike in all columns fall into the same place and are taken one by one in any order. An
    empty table gives an empty one. ``df`` is read twice and must give the same rows each time.

    Pass 1 counts rows by (piece, slot), combined map-side, into a written table; the driver
    replays the arrivals on the counts of the pieces alone (more than MOST_PIECES raise
    ValueError), and the survivors of each piece are split over its slots in tasks. Pass 2 ranks
    rows within each (piece, slot); before that exchange each task drops rows whose place is far
    behind the number wanted, so little more than the sample moves. There are slots enough that
    none holds much more than SLOT_ROWS of the sample. Should a group run short (once in about
    10^9), pass 2 is repeated without dropping.
    """
    if k < 0 or slots is not None and slots < 1:
        raise ValueError("k can't be below 0, slots must be at least 1")
    slots, spark = slots or slots_for(k), df.sparkSession
    batch, slot, place, take, total = (fresh_name(df, f"__{x}") for x in ("batch", "slot", "place", "take", "total"))
    ids = [F.col(f"`{id}`")] if id else []
    others = [F.col(f"`{c}`") for c, kind in df.dtypes if c != id and "map" not in kind]
    tie = F.xxhash64(F.lit(seed + 1), *ids, *others)
    marked = df.withColumns({
        batch: F.coalesce(F.col(f"`{piece}`").cast("bigint"), F.lit(-(2**63))),
        slot: F.pmod(F.xxhash64(F.lit(seed + 2), *ids), F.lit(slots)),
        place: F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 11),
    })
    cells = written(marked.groupBy(batch, slot).agg(F.count("*").alias(total)))
    whole = cells.groupBy(batch).agg(F.sum(total).alias("rows")).orderBy(batch).limit(MOST_PIECES + 1).toArrow()
    if whole.num_rows > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces; feed them to a Reservoir")
    counts = whole["rows"].to_numpy().astype(np.int64)
    kept = survivors(counts.reshape(-1, 1), k, np.random.default_rng(seed))[:, 0] if len(counts) else counts
    some = kept > 0
    alive = pa.table({batch: pa.array(whole[batch].to_numpy()[some], pa.int64()), take: pa.array(kept[some], pa.int64())})

    def over_slots(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(slot)
        rng = np.random.default_rng([seed, int(frame[batch].iloc[0]) % 2**64])
        return frame.assign(**{take: split(rng, frame[total].to_numpy(), int(frame[take].iloc[0]))})[[batch, slot, total, take]]

    wanted = cells.join(spark.createDataFrame(alive), batch) if len(alive) else cells.withColumn(take, F.lit(0).cast("bigint")).limit(0)
    use = written(wanted.groupBy(batch).applyInPandas(over_slots, f"`{batch}` bigint, `{slot}` bigint, `{total}` bigint, `{take}` bigint").filter(F.col(take) > 0))
    share = (F.col(take) + headroom * F.sqrt(F.col(take)) + 2 * headroom) / F.col(total)

    def choose(pruned: bool) -> DataFrame:
        rows, uniform = marked, F.col(place) / F.lit(float(1 << 53))
        if pruned:
            most = use.agg(F.max(share)).first()[0] or 0.0
            rows = rows.filter(uniform < F.lit(float(most))) if most < 1 else rows
        rows = rows.join(use, [batch, slot])
        if pruned:
            rows = rows.filter((share >= 1) | (uniform < share))
        ranked = rows.withColumn(total, F.row_number().over(Window.partitionBy(batch, slot).orderBy(place, tie)))
        return ranked.filter(F.col(total) <= F.col(take)).select(df.columns)

    sample = checkpointed(choose(True))
    if sample.count() != int(kept.sum()):
        sample = checkpointed(choose(False))
    return sample


class Reservoir:
    """The reservoir itself, for pieces that really arrive one after the other, for instance in ``foreachBatch``.

    Each ``add`` reads the piece twice (its counts by slot, then the rows it gives) and writes
    only those to the shared folder, with a random rank within their slot. Evictions are drawn,
    split over the slots and the parts written before, and kept as numbers: of a slot's rows in
    a part the first so many ranks are alive. After MOST_PARTS parts, or when less than half of
    what is written is alive, the sample is written anew. On the driver are a number for each
    part and slot. Slots hold about SLOT_ROWS rows, which bounds every task.
    """

    def __init__(self, k: int, id: str, slots: int | None = None, seed: int = 5):
        self.k, self.id, self.slots, self.seed = k, id, slots or slots_for(k), seed
        self.rng = np.random.default_rng(seed)
        self.parts: list[DataFrame] = []
        self.alive = np.zeros((0, self.slots), np.int64)
        self.stored = self.seen = self.step = 0
        self.names: tuple[str, ...] = ()

    def _slot(self):
        return F.pmod(F.xxhash64(F.lit(self.seed + 2), F.col(f"`{self.id}`")), F.lit(self.slots))

    def _ranked(self, df: DataFrame, most: np.ndarray) -> DataFrame:
        """The first ``most[slot]`` rows of each slot in a random order, with slot and rank."""
        slot, rank, take = self.names
        columns = [F.col(f"`{c}`") for c, kind in df.dtypes if "map" not in kind]
        order = [F.xxhash64(F.lit(self.seed), F.lit(self.step), F.col(f"`{self.id}`")), F.xxhash64(F.lit(self.step), *columns)]
        use = df.sparkSession.createDataFrame(pa.table({slot: pa.array(np.flatnonzero(most)), take: pa.array(most[most > 0])}))
        bound = int(most.max(initial=0))  # a constant, which prunes before the exchange
        ranked = df.withColumn(slot, self._slot()).withColumn(rank, F.row_number().over(Window.partitionBy(slot).orderBy(*order))).filter(F.col(rank) <= bound)
        return ranked.join(use, slot).filter(F.col(rank) <= F.col(take)).select(*[F.col(f"`{c}`") for c in df.columns], slot, rank)

    def sample(self) -> DataFrame | None:
        """The rows that are in the reservoir now; null before the first piece."""
        if not self.parts:
            return None
        slot, rank, take = self.names
        out = None
        for part, alive in zip(self.parts, self.alive):
            use = part.sparkSession.createDataFrame(pa.table({slot: pa.array(np.arange(self.slots)), take: pa.array(alive)}))
            rows = part.join(use, slot).filter(F.col(rank) <= F.col(take)).drop(slot, rank, take)
            out = rows if out is None else out.unionByName(rows)
        return out

    def add(self, piece: DataFrame) -> DataFrame:
        """Takes in ``piece`` and gives the sample after it; an empty piece changes nothing."""
        self.step += 1
        self.names = self.names or tuple(fresh_name(piece, f"__{x}") for x in ("slot", "rank", "take"))
        counts = np.zeros(self.slots, np.int64)
        for s, n in piece.groupBy(self._slot().alias("slot")).count().collect():
            counts[s] = n
        n, held = int(counts.sum()), self.alive.sum(axis=0)
        full = min(self.k, self.seen + n)
        new = hypergeometric(self.rng, n, self.seen, full)
        evicted = split(self.rng, held, int(held.sum()) + new - full)
        for s in np.flatnonzero(evicted):
            self.alive[:, s] -= split(self.rng, self.alive[:, s], int(evicted[s]))
        inserted = split(self.rng, counts, new)
        if new or not self.parts:
            self.parts.append(checkpointed(self._ranked(piece, inserted)))
            self.alive = np.vstack([self.alive, inserted])
            self.stored += new
        self.seen += n
        if len(self.parts) > MOST_PARTS or self.stored > 2 * max(1, full):
            held = self.alive.sum(axis=0)
            self.parts = [checkpointed(self._ranked(self.sample(), held))]
            self.alive, self.stored = held.reshape(1, -1), int(held.sum())
        return self.sample()
