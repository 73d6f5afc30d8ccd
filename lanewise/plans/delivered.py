"""The sequencing operators on the tables as delivered: nulls, odd and missing names, trimmed and repeated reads, sheets of all forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import names
from lanewise.operators import mixing, ncontent, search, sheets
from lanewise.plans.archive import CELLS
from lanewise.runtime import ensure_checkpoint_dir, table
from lanewise.streaming import barcodes

COLUMNS = ("Lane", "Sample_ID", "Sample_Name", "Sample_Project", "index", "index2", "OverrideCycles")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of each run's files; their ids give the order in a file."""
    r = table(spark, sf_dir, "reads")
    return r.select("read_id", "run_id", F.concat_ws("/", F.col("run_id").cast("string"), "file").alias("file"), F.col("read_id").alias("pos"), "name", "sequence", "quality")


def delivered_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.barcode_counts(mixing.undetermined(reads(spark, sf_dir), strict=False))


def delivered_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent barcodes of each file; reads without barcode count for the totals."""
    rows = mixing.top_barcodes(mixing.undetermined(reads(spark, sf_dir), strict=False), 10)
    return rows.withColumn("Fraction", F.round("Fraction", 9))


def delivered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).select("read_id", names.read_name_fields(F.col("name"), strict=False).alias("f")).select("read_id", "f.*")


def delivered_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N by cycle and tile of the files in which all reads with an N have a name."""
    return ncontent.n_by_cycle_filled(ncontent.n_positions(reads(spark, sf_dir)))


def delivered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matches(reads(spark, sf_dir).select("read_id", "sequence"), ["GATTACA"], 1)
    return found.select("read_id", "errors", F.array_join("captures", " ").alias("captures"))


def delivered_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by lane over the largest row of each barcode; a null lane or barcode is a group, null counts add nothing."""
    rows = mixing.by_lane(table(spark, sf_dir, "mixing_results"))
    return rows.withColumn("Lane_Fraction", F.round("Lane_Fraction", 6))


def delivered_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.named_rows(table(spark, sf_dir, "sheet_lines"), COLUMNS)


def delivered_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index mixing of all runs at once: barcodes of each run's reads against its own sheets."""
    counts = mixing.barcode_counts(mixing.undetermined(reads(spark, sf_dir), strict=False))
    found = counts.select(F.split_part("file", F.lit("/"), F.lit(1)).cast("bigint").alias("run_id"), "Lane", "Undetermined_Index", "Count", F.lit(0.0).alias("Fraction"))
    rows = sheets.named_rows(table(spark, sf_dir, "sheet_lines"), COLUMNS, sheets.REQUIRED)
    sheet = rows.join(table(spark, sf_dir, "sheet_files").select("sheet_id", "run_id"), "sheet_id").select(
        "run_id", names.lane_name(F.col("Lane")).alias("Lane"), "Sample_Project", F.col("index").alias("index1"), "index2")
    return mixing.unexpected(mixing.index_mixing(sheet, found, ["run_id"]), sheet, ["run_id"]).drop("Fraction")


def streamed_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode counts by hour of loading, by a stream over the table's files."""
    schema = table(spark, sf_dir, "reads").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/reads.parque[t]")  # a pattern, as the table may be a file or a folder
    at = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    barcodes.write_all(barcodes.barcode_counts(stream), f"{at}/out", f"{at}/state").awaitTermination()
    rows = spark.read.schema("start timestamp, file string, idx string, Count long").parquet(f"{at}/out")
    return rows.withColumn("start", F.unix_micros("start"))


QUERIES = {f.__name__: f for f in (delivered_barcodes, delivered_top, delivered_names, delivered_n, delivered_search, delivered_lanes, delivered_sheets, delivered_mixing, streamed_barcodes)}

READS = "(select read_id, run_id, cast(run_id as varchar) || '/' || file as file, read_id as pos, name, sequence from reads)"
COUNTED = f"""(select file, split_part(split_part(file, '/', 2), '_', 3) as "Lane", case when contains(name, ' ') then list_extract(string_split(split_part(name, ' ', 2), ':'), -1) end as "Undetermined_Index",
    count(*) as "Count", min(pos) as first from {READS} r group by 1, 2, 3)"""
N_ALL = f"""(select file, cast(split_part(core, ':', 5) as int) as tile, cycle from (select file, split_part(name, ' ', 1) as core, sequence, cast(unnest(range(0, length(sequence))) as int) as cycle from {READS} r
    where file not in (select file from {READS} b where contains(sequence, 'N') and name is null)) c where substring(sequence, cycle + 1, 1) = 'N')"""
SHEETS = f"""{CELLS},
wide as (select i.sheet_id, i.line_no, {", ".join(f"nullif(i.c[list_position(h.header, '{c}')], '') as {chr(34)}{c}{chr(34)}" for c in COLUMNS)}, h.header
  from inside i join head h on i.sheet_id = h.sheet_id where i.n > 1)"""


def near(index: str) -> str:
    text = '"Undetermined_Index"'
    return f"(length({index}) <= length({text}) and len(list_filter(range(1, length({text}) - length({index}) + 2), lambda p: hamming(substring({text}, p, length({index})), {index}) <= 1)) > 0)"


ORACLE = {
    "delivered_barcodes": f'select * from {COUNTED} c where "Undetermined_Index" is not null',
    "delivered_top": f"""select c.file, "Lane", "Undetermined_Index", "Count", round("Count" / total, 9) as "Fraction" from (
        select *, row_number() over (partition by file order by "Count" desc, first, "Undetermined_Index") as place from {COUNTED} c
        where not contains("Undetermined_Index", 'GGGG')) c join (select file, count(*) as total from {READS} r group by 1) t on c.file = t.file where place <= 10""",
    "delivered_names": f"""with p as (select read_id, name, regexp_matches(name, '^[A-Za-z0-9_]+:[0-9]+:[A-Za-z0-9]+(:[0-9]+)' || '{{4}}') as ok, string_split(split_part(name, ' ', 1), ':') as c, string_split(split_part(name, ' ', 2), ':') as k from {READS} r)
        select read_id, case when ok then c[1] end as instrument, case when ok then cast(c[2] as int) end as run_number, case when ok then c[3] end as flowcell_id, case when ok then cast(c[4] as int) end as lane,
          case when ok then cast(c[5] as int) end as tile, case when ok then cast(c[6] as int) end as x, case when ok then cast(c[7] as int) end as y,
          case when ok then nullif(split_part(c[8], '+', 1), '') end as umi1, case when ok then nullif(split_part(c[8], '+', 2), '') end as umi2,
          case when ok then try_cast(k[1] as int) end as read, case when ok then k[2] end as is_filtered, case when ok then try_cast(k[3] as int) end as control, case when ok then k[4] end as barcode from p""",
    "delivered_n": f"""select file, cycle, tile, cast(sum(n) as bigint) as n_count from (select file, cycle, tile, 1 as n from {N_ALL} a
        union all select t.file, cast(unnest(range(1, last + 1)) as int), tile, 0 from (select distinct file, tile from {N_ALL} b) t join (select file, max(cycle) as last from {N_ALL} c group by 1) l on t.file = l.file) u group by 1, 2, 3""",
    "delivered_search": f"""select read_id, cast(hamming(substring(sequence, p, 7), 'GATTACA') as int) as errors, substring(sequence, p, 7) as captures from (
        select read_id, sequence, unnest(range(1, length(sequence) - 5)) as p from {READS} r) w where hamming(substring(sequence, p, 7), 'GATTACA') <= 1 qualify row_number() over (partition by read_id order by p) = 1""",
    "delivered_lanes": """select "Lane", cast(sum("Count") as bigint) as "Lane_Count", round(sum("Fraction"), 6) as "Lane_Fraction" from (
        select * from mixing_results qualify row_number() over (partition by "Lane", "Undetermined_Index" order by "Count" desc nulls last, "Fraction" desc nulls last) = 1) t group by 1""",
    "streamed_barcodes": """select epoch_us(loaded_at) // 3600000000 * 3600000000 as start, file, idx, count(*) as "Count" from reads where not contains(idx, 'GGGG') group by 1, 2, 3""",
    "delivered_sheets": f"{SHEETS} select * exclude (header) from wide",
    "delivered_mixing": f"""{SHEETS}, s as (select f.run_id, case when length(l) < 4 then lpad(l, 4, 'L') else l end as "Lane", "Sample_Project", index as index1, index2
          from (select *, case when length("Lane") < 3 then lpad("Lane", 3, '0') else "Lane" end as l from wide where list_contains(header, 'Lane') and list_contains(header, 'Sample_Project') and list_contains(header, 'index')) w
          join sheet_files f on f.sheet_id = w.sheet_id),
        u as (select cast(split_part(file, '/', 1) as bigint) as run_id, "Lane", "Undetermined_Index", "Count" from {COUNTED} c where "Undetermined_Index" is not null)
        select u.run_id, u."Lane", "Undetermined_Index", "Count", s."Sample_Project", s."Lane" as "Lane_Project", index1, index2 from u join s on u.run_id = s.run_id and u."Lane" <> s."Lane"
        where {near("index1")} and (index2 is null or {near("index2")})
          and not exists (select 1 from s o where o.run_id = u.run_id and o."Lane" = u."Lane" and o.index1 = s.index1 and o.index2 = s.index2)""",
}
