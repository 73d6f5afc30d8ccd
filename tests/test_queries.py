"""Every registered query against its SQL on the smallest tables, and the stream against the batch."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanewise.plans import archive, delivered, sequencing
from lanewise.streaming import barcodes

DATA = "/root/testdata/sf0.001"
ORACLE = sequencing.ORACLE | archive.ORACLE | delivered.ORACLE


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if hasattr(value, "quantize") else value


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, engine, name):
    rows = entry.queries()[name](spark, DATA)
    found = engine.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    order = sorted(names)
    want = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in order) for r in rows.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted((sequencing.QUERIES | archive.QUERIES | delivered.QUERIES).keys() - ORACLE.keys()))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 45


def test_streamed_counts_equal_those_of_the_batch(spark, tmp_path):
    reads = spark.read.parquet(f"{DATA}/reads.parquet").select("file", "idx", "loaded_at")
    reads.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    barcodes.write(barcodes.barcode_counts(stream, "36500 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema("start timestamp, file string, idx string, Count long").parquet(str(tmp_path / "out")).count() == 0  # no window has closed
    late = reads.select("file", "idx", (F.col("loaded_at") + F.expr("interval 200 years")).alias("loaded_at")).limit(1)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    barcodes.write(barcodes.barcode_counts(stream, "36500 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("file", "idx").agg(F.sum("Count").alias("n"))
    want = reads.filter("idx is not null and idx not like '%GGGG%'").groupBy("file", "idx").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
