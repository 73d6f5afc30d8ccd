"""Top-n, heavy items and the reservoir against brute force, with nulls, ties, repeats, clashing names and empty tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import heavy, reservoir, topn


def test_top_items_against_brute_force(spark):
    rng = random.Random(1)
    some = lambda x: None if rng.random() < 0.05 else x
    rows = [(rng.choice([1, 1, 1, 2, None]), some(rng.choice("ab")), some(f"i{rng.randint(0, 60)}"), some(rng.randint(0, 9)), "x", 1) for _ in range(3000)]
    rows += rows[:100]
    best = defaultdict(dict)
    for g, h, i, c, *_ in rows:
        if None not in (g, h, i, c):
            best[g, h][i] = max(best[g, h].get(i, -1), c)
    want = {(*g, i, c, r) for g, items in best.items() for r, (i, c) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:5], start=1)}
    df = spark.createDataFrame(rows, "run int, Lane string, item string, Count int, salt string, rank int")
    for salts in (1, 32):
        found = topn.top_items(df, ["run", "Lane"], "item", "Count", 5, salts)
        assert found.columns == ["run", "Lane", "item", "Count", "rank"]
        assert {tuple(r) for r in found.collect()} == want
    assert topn.top_items(df.limit(0), ["run"], "item", "Count").count() == 0


def heavy_plain(rows, share):
    sums = Counter()
    for i, w in rows:
        if i is not None:
            sums[i] += w or 0
    whole = sum(sums.values())
    return {(i, s) for i, s in sums.items() if whole and s >= share * whole}


@pytest.mark.parametrize("width", [2, 64, 1024])
def test_heavy_items_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([f"v{int(rng.expovariate(0.05))}", f"u{rng.random()}", None, ""]), rng.choice([None, 0, 1, 5, 2**40])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "item string, weight long").withColumn("print", F.lit("clash"))
    for share in (0.02, 0.2):
        found = heavy.heavy_items(df, "item", "weight", share, width=width).collect()
        assert {(r["item"], r["total"]) for r in found} == heavy_plain(rows, share)
        assert all(r["estimate"] >= r["total"] for r in found)


def test_heavy_items_of_unusual_tables(spark):
    df = spark.createDataFrame([("a", 0), ("b", None), (None, 7)], "item string, weight long")
    assert heavy.heavy_items(df, "item", "weight").count() == 0
    assert heavy.heavy_items(df.limit(0), "item", "weight").count() == 0
    assert [r["total"] for r in heavy.heavy_items(df, "item", None, 0.5).collect()] == [1, 1]
    with pytest.raises(Exception, match="below 0"):
        heavy.heavy_items(spark.createDataFrame([("a", -1)], "item string, weight long"), "item", "weight")
    exact = spark.createDataFrame([("a", 1), ("b", 99)], "item string, weight long")
    assert {r["item"] for r in heavy.heavy_items(exact, "item", "weight", 0.01).collect()} == {"a", "b"}


def test_hypergeometric_of_large_populations():
    rng = np.random.default_rng(1)
    draws = [reservoir.hypergeometric(rng, 3 * 10**9, 10**9, 400) for _ in range(300)]
    assert abs(np.mean(draws) - 300) < 3 and abs(np.var(draws) - 75) < 25


@pytest.mark.parametrize(("good", "bad", "draws"), [(5, 7, 6), (40, 3, 20), (1000, 9000, 300), (3, 10**6, 10**5)])
def test_hypergeometric_chances(good, bad, draws):
    rng = np.random.default_rng(3)
    own = np.array([reservoir.hypergeometric(rng, good, bad, draws) for _ in range(20_000)])
    other = rng.hypergeometric(good, bad, draws, 20_000)
    for x in np.unique(other):
        a, b = (own == x).mean(), (other == x).mean()
        assert abs(a - b) < 5 * np.sqrt((a + b) / 20_000)


def test_counts_of_survivors_are_uniform():
    counts = np.array([[3, 1], [0, 0], [10, 2], [1, 30], [5, 5]])
    rng = np.random.default_rng(2)
    runs = np.array([reservoir.survivors(counts, 12, rng) for _ in range(4000)])
    assert (runs.sum(axis=(1, 2)) == 12).all() and (runs <= counts).all()
    assert np.abs(runs.mean(axis=0) - counts * 12 / counts.sum()).max() < 0.15
    n, k, c = counts.sum(), 12, counts[3, 1]
    want = k * c / n * (1 - c / n) * (n - k) / (n - 1)
    assert abs(runs[:, 3, 1].var() - want) < 0.25


def table(spark, n=400):
    rows = [(i, (i * i) % 7 if i % 50 else None, "x" if i % 3 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "read_id long, chunk_id long, batch string, take long").repartition(5)


def test_each_row_is_equally_likely(spark):
    df = table(spark).cache()
    seen = Counter()
    for seed in range(40):
        sample = reservoir.reservoir_sample(df, 100, "chunk_id", "read_id", slots=3, seed=seed).collect()
        ids = [r["read_id"] for r in sample]
        assert len(ids) == len(set(ids)) == 100
        seen.update(ids)
    per_row = np.array([seen[i] for i in range(400)])
    assert abs(per_row.var() - 40 * 0.25 * 0.75) < 2.5  # as of independent samples
    by_piece = np.array([per_row[[i for i in range(400) if (i * i) % 7 == p and i % 50]].mean() for p in (0, 1, 2, 4)])
    assert np.abs(by_piece - 10).max() < 0.8


def test_the_sample_does_not_depend_on_how_rows_lie(spark):
    df = table(spark)
    a = {r["read_id"] for r in reservoir.reservoir_sample(df, 50, "chunk_id", "read_id").collect()}
    b = {r["read_id"] for r in reservoir.reservoir_sample(df.repartition(9).sortWithinPartitions("batch"), 50, "chunk_id", "read_id", headroom=40.0).collect()}
    assert a == b


def test_samples_of_unusual_tables(spark):
    df = table(spark, 30)
    assert reservoir.reservoir_sample(df, 100, "chunk_id", "read_id").columns == df.columns
    assert reservoir.reservoir_sample(df, 100, "chunk_id", "read_id").count() == 30
    assert reservoir.reservoir_sample(df, 0, "chunk_id", "read_id").count() == 0
    assert reservoir.reservoir_sample(df.limit(0), 10, "chunk_id", "read_id").count() == 0
    twice = spark.createDataFrame([(1, 1, "x", 1), (1, 1, "x", 1), (None, None, None, None)], df.schema)
    assert reservoir.reservoir_sample(twice, 2, "chunk_id", "read_id").count() == 2
    # without room the first pass falls short and the second repeats it whole
    assert reservoir.reservoir_sample(table(spark), 100, "chunk_id", "read_id", headroom=-5.0).count() == 100
    assert reservoir.reservoir_sample(table(spark), 100, "chunk_id", "read_id", slots=7).count() == 100


def test_a_reservoir_fed_piece_by_piece(spark):
    seen = Counter()
    for seed in range(25):
        state = reservoir.Reservoir(20, "id", slots=2, seed=seed)
        for low, high in ((0, 15), (15, 15), (15, 70), (70, 80)):
            piece = spark.range(low, high).withColumn("__slot", F.lit("clash"))
            sample = state.add(piece)
            assert sample.count() == min(20, high) and sample.columns == ["id", "__slot"]
        ids = [r["id"] for r in sample.collect()]
        assert len(set(ids)) == 20
        seen.update("first" if i < 15 else "second" if i < 70 else "third" for i in ids)
    for name, n in (("first", 15), ("second", 55), ("third", 10)):
        assert abs(seen[name] / 25 - n / 4) < 1.6


def test_a_reservoir_is_written_anew(spark, monkeypatch):
    monkeypatch.setattr(reservoir, "MOST_PARTS", 2)
    seen = Counter()
    for seed in range(8):
        state = reservoir.Reservoir(30, "id", slots=3, seed=seed)
        for low in range(0, 120, 20):
            sample = state.add(spark.range(low, low + 20))
            assert len(state.parts) <= 2
        ids = [r["id"] for r in sample.collect()]
        assert len(ids) == len(set(ids)) == 30
        seen.update(i // 60 for i in ids)
    assert abs(seen[0] / 8 - 15) < 5
