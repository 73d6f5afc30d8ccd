"""Queries of the sequencing operators over the views, each beside its SQL."""

from __future__ import annotations

import csv
import gzip
import re
import uuid
from collections.abc import Callable
from datetime import datetime
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import encode, fuzzy, masks, names
from lanewise.operators import mixing, ncontent, rewind, search, sheets, synth
from lanewise.plans import runs
from lanewise.plans.views import sql, view
from lanewise.runtime import ensure_checkpoint_dir
from lanewise.sources import files, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CYCLES = 32
PATTERNS = ["ACGT", "GGTACA", "TTTTT"]


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = sql(text)
        return f

    return add


def rounded(column: str):
    return F.round(column, 9).alias(column)


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


# index mixing

COUNTS = """select file, substring(file, 17, 4) as "Lane", idx as "Undetermined_Index", count(*) as "Count", min(pos) as first from {reads} r group by 1, 2, 3"""


def top_sql(n: int) -> str:
    return f"""select c.file, "Lane", "Undetermined_Index", "Count", "Count" / total as "Fraction" from (
        select *, row_number() over (partition by file order by "Count" desc, first, "Undetermined_Index") as place from ({COUNTS}) c
        where "Undetermined_Index" not like '%GGGG%') c
        join (select file, count(*) as total from {{reads}} r group by 1) t on c.file = t.file where place <= {n}"""


def fit_sql(text: str, index: str) -> str:
    return f"(length({index}) <= length({text}) and len(list_filter(range(1, length({text}) - length({index}) + 2), lambda p: hamming(substring({text}, p, length({index})), {index}) <= 1)) > 0)"


HITS = f"""select u."Lane", "Undetermined_Index", "Count", "Fraction", s.Sample_Project as "Sample_Project", s.Lane as "Lane_Project", index1, index2
    from ({top_sql(1000)}) u join {{sheet}} s on u."Lane" <> s.Lane
    where {fit_sql('"Undetermined_Index"', "index1")} and (index2 is null or {fit_sql('"Undetermined_Index"', "index2")})"""
UNEXPECTED = f"""select h.* from ({HITS}) h where not exists (select 1 from {{sheet}} s where s.Lane = h."Lane" and s.index1 = h.index1 and s.index2 = h.index2)"""
BY_BARCODE = f"""select "Lane", "Undetermined_Index", max("Count") as "Count", max_by("Fraction", "Count") as "Fraction",
    string_agg("Sample_Project", ',' order by "Sample_Project", "Lane_Project") as "Sample_Project",
    string_agg("Lane_Project", ',' order by "Sample_Project", "Lane_Project") as "Lane_Project" from ({UNEXPECTED}) u group by 1, 2"""


def nine(select: str, text: str) -> str:
    return f'select {select}, round("Fraction", 9) as "Fraction" from ({text}) x'


def _top(spark, d, n=mixing.TOP):
    return mixing.top_barcodes(mixing.undetermined(view(spark, d, "reads")), n)


def _sheet(spark, d):
    return view(spark, d, "sheet")


def _unexpected(spark, d):
    sheet = _sheet(spark, d)
    return mixing.unexpected(mixing.index_mixing(sheet, _top(spark, d)), sheet)


@query(nine('"Lane", "Undetermined_Index", "Count", "Sample_Project", "Lane_Project", index1, index2', UNEXPECTED))
def unexpected_indexes(spark, d):
    return _unexpected(spark, d).withColumn("Fraction", F.round("Fraction", 9))


@query(nine('"Lane", "Undetermined_Index", "Count", "Sample_Project", "Lane_Project", index1, index2', HITS))
def index_mixing(spark, d):
    return mixing.index_mixing(_sheet(spark, d), _top(spark, d)).withColumn("Fraction", F.round("Fraction", 9))


@query(f"""select file, "Lane", "Undetermined_Index", "Count", first from ({COUNTS}) c""")
def barcode_counts(spark, d):
    return mixing.barcode_counts(mixing.undetermined(view(spark, d, "reads")))


@query(nine('file, "Lane", "Undetermined_Index", "Count"', top_sql(1000)))
def barcode_fraction(spark, d):
    return _top(spark, d).withColumn("Fraction", F.round("Fraction", 9))


@query(nine('file, "Lane", "Undetermined_Index", "Count"', top_sql(25)))
def topk_barcodes(spark, d):
    return _top(spark, d, 25).withColumn("Fraction", F.round("Fraction", 9))


@query(f"""select "Lane", "Undetermined_Index", "Count" from ({top_sql(1000)}) x""")
def barcode_union(spark, d):
    return _top(spark, d).select("Lane", "Undetermined_Index", "Count")


@query("""select read_id, idx from {reads} r where idx not like '%GGGG%'""")
def polyg_filter(spark, d):
    return view(spark, d, "reads").filter(~F.col("idx").contains(mixing.POLY_G)).select("read_id", "idx")


@query(nine('"Lane", "Undetermined_Index", "Count", "Sample_Project", "Lane_Project"', BY_BARCODE))
def dedup_barcodes(spark, d):
    return mixing.by_barcode(_unexpected(spark, d)).select(
        "Lane", "Undetermined_Index", "Count", rounded("Fraction"), F.array_join("Sample_Project", ",").alias("Sample_Project"), F.array_join("Lane_Project", ",").alias("Lane_Project"))


@query(f"""select "Lane", cast(sum("Count") as bigint) as "Lane_Count", round(sum("Fraction"), 9) as "Lane_Fraction" from ({BY_BARCODE}) x group by 1""")
def lane_summary(spark, d):
    return mixing.by_lane(_unexpected(spark, d)).select("Lane", "Lane_Count", rounded("Lane_Fraction"))


#: Rows of the reports of the whole tool, where an empty second index of a sheet is an empty text.
_SECOND = fit_sql('"Undetermined_Index"', "index2")
REPORTED = UNEXPECTED.replace(f"index2 is null or {_SECOND}", f"index2 = '' or {_SECOND.replace('index2', "nullif(index2, '')")}").replace("{sheet}", "(select Lane, Sample_Project, index1, coalesce(index2, '') as index2 from {sheet} q)")


def _reports(spark, d) -> tuple[list[list[str]], list[list[str]]]:
    """Cells of both reports of the mixing tool, from FASTQ files and a sheet to CSV files."""
    source, out = folder(spark), folder(spark)
    files.write_sequences(view(spark, d, "reads"), source)
    rows = view(spark, d, "sheet").collect()
    sheet = "[Data]\nLane,Sample_Project,index,index2\n" + "".join(f"{r['Lane']},{r['Sample_Project']},{r['index1']},{r['index2'] or ''}\n" for r in rows)
    files.make_folder(out)
    paths = [f"{out}/{x}.csv" for x in ("unexpected_indexes", "lane_summary")]
    for path, report in zip(paths, runs.mixing_report(spark, source, sheet)):
        runs.write_csv(report, path)
    return tuple(list(csv.reader(files.read_text(p).splitlines()))[1:] for p in paths)


@query(f"""select row_number() over (order by "Lane", "Count" desc, "Undetermined_Index", "Fraction", "Sample_Project", "Lane_Project", index1, index2) as ord,
    "Lane", "Undetermined_Index", "Count", round("Fraction", 9) as "Fraction", "Sample_Project", "Lane_Project", index1, index2 from ({REPORTED}) u""")
def mixing_report(spark, d):
    rows = [(n, r[0], r[1], int(r[2]), round(float(r[3]), 9), *r[4:]) for n, r in enumerate(_reports(spark, d)[0], start=1)]
    return spark.createDataFrame(rows, "ord long, Lane string, Undetermined_Index string, Count long, Fraction double, Sample_Project string, Lane_Project string, index1 string, index2 string")


@query(f"""select row_number() over (order by "Lane") as ord, "Lane", cast(sum("Count") as bigint) as "Lane_Count", round(sum("Fraction"), 9) as "Lane_Fraction"
    from (select distinct "Lane", "Undetermined_Index", "Count", "Fraction" from ({REPORTED}) u) x group by 2""")
def mixing_summary(spark, d):
    rows = [(n, r[0], int(r[1]), round(float(r[2]), 9)) for n, r in enumerate(_reports(spark, d)[1], start=1)]
    return spark.createDataFrame(rows, "ord long, Lane string, Lane_Count long, Lane_Fraction double")


# names

@query("""select read_id, idx as barcode from {reads} r""")
def barcode_extract(spark, d):
    return view(spark, d, "reads").select("read_id", names.barcode(F.col("name")).alias("barcode"))


@query("""select s_suppkey, 'L' || lpad(cast(s_suppkey % 120 as varchar), 3, '0') as lane, cast(1000 + s_suppkey as varchar) as long_lane from supplier where s_suppkey < 9000
    union all select s_suppkey, 'L' || lpad(cast(s_suppkey % 120 as varchar), 3, '0'), cast(1000 + s_suppkey as varchar) from supplier where s_suppkey >= 9000""")
def lane_norm(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    return s.select("s_suppkey", names.lane_name((F.col("s_suppkey") % 120).cast("string")).alias("lane"), names.lane_name((1000 + F.col("s_suppkey")).cast("string")).alias("long_lane"))


@query("""select read_id, cast(tile as int) as tile, cast(x as int) as x, cast(y as int) as y from {reads} r""")
def tile_coords(spark, d):
    return view(spark, d, "reads").select("read_id", names.tile_coordinates(F.col("name")).alias("c")).select("read_id", "c.*")


@query("""select read_id, 'VH00001' as instrument, 1 as run_number, 'AABCCC' as flowcell_id, cast(lane as int) as lane, cast(tile as int) as tile, cast(x as int) as x,
    cast(y as int) as y, cast(null as varchar) as umi1, cast(null as varchar) as umi2, 1 as read, 'N' as is_filtered, 0 as control, idx as barcode from {reads} r""")
def read_name_fields(spark, d):
    return view(spark, d, "reads").select("read_id", names.read_name_fields(F.col("name")).alias("f")).select("read_id", "f.*")


FILES_SQL = """select s_suppkey, 'dir/name' || cast(s_suppkey as varchar) || '_S' || cast(s_suppkey as varchar) || '_L00' || cast(s_suppkey % 8 + 1 as varchar) || '_R' ||
    cast(s_nationkey % 2 + 1 as varchar) || '_001' || case s_suppkey % 5 when 0 then '.fastq' when 1 then '.fastq.gz' when 2 then '.fa.gz' when 3 then '.txt' else '.fq.gz' end as file from supplier"""


def _files(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    end = F.element_at(F.array(*map(F.lit, (".fastq", ".fastq.gz", ".fa.gz", ".txt", ".fq.gz"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    key = F.col("s_suppkey").cast("string")
    return s.select("s_suppkey", F.concat(F.lit("dir/name"), key, F.lit("_S"), key, F.lit("_L00"), (F.col("s_suppkey") % 8 + 1).cast("string"), F.lit("_R"), (F.col("s_nationkey") % 2 + 1).cast("string"), F.lit("_001"), end).alias("file"))


@query(f"""select s_suppkey, case s_suppkey % 5 when 0 then 'FASTQ' when 1 then 'FASTQ' when 2 then 'FASTA' when 4 then 'FASTQ' end as kind from ({FILES_SQL}) f""")
def input_type(spark, d):
    return _files(spark, d).select("s_suppkey", names.input_type(F.col("file")).alias("kind"))


@query("""with f as (select 'name' || cast(s_suppkey as varchar) as n, s_suppkey % 8 + 1 as l from supplier)
    select 'L00' || cast(l as varchar) as lane, n || '_L00' || cast(l as varchar) || '_001' as sample,
    n || '_L00' || cast(l as varchar) || '_R1_001.fastq.gz,' || n || '_L00' || cast(l as varchar) || '_R2_001.fastq.gz' as files from f""")
def organise_files(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    base = F.concat(F.lit("name"), F.col("s_suppkey").cast("string"), F.lit("_L00"), (F.col("s_suppkey") % 8 + 1).cast("string"))
    every = s.select(F.explode(F.array(F.concat(base, F.lit("_R2_001.fastq.gz")), F.concat(base, F.lit("_R1_001.fastq.gz")))).alias("file"))
    return rewind.organise(every).select("lane", "sample", F.array_join("files", ",").alias("files"))


DAY = "cast('2024-03-05' as date)"


@query(f"""select s_suppkey, strftime({DAY}, '%y%m%d') || 'VH1' || '_' || case when s_suppkey < 10000 then lpad(cast(s_suppkey as varchar), 4, '0') else cast(s_suppkey as varchar) end || '_FC1' as run_id from supplier""")
def run_id(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", names.run_id(F.expr(DAY), F.lit("VH1"), F.col("s_suppkey"), F.lit("FC1")).alias("run_id"))


@query(f"""select s_suppkey, '20240305_VH1_' || case when s_suppkey < 10000 then lpad(cast(s_suppkey as varchar), 4, '0') else cast(s_suppkey as varchar) end || '_AFC1' as name from supplier""")
def flowcell_name(spark, d):
    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", synth.flowcell_name(F.expr(DAY), F.lit("VH1"), F.col("s_suppkey"), F.lit("FC1")).alias("name"))


@query("""select row_no, case when index = '' then ' 1:N:0:NNNNNNNN' when index2 is null then ' 1:N:0:' || index else ' 1:N:0:' || index || '+' || index2 end as extension
    from (select row_no, case when row_no % 4 = 0 then '' else index end as index, index2 from {samples} s) t""")
def read_extension(spark, d):
    s = view(spark, d, "samples").withColumn("index", F.when(F.col("row_no") % 4 == 0, "").otherwise(F.col("index")))
    return s.select("row_no", names.read_extension(F.col("index"), F.col("index2"), True).alias("extension"))


# N content

N_ALL = "select file, tile, x, y, cycle from (select file, cast(tile as int) as tile, cast(x as int) as x, cast(y as int) as y, sequence, cast(unnest(range(0, length(sequence))) as int) as cycle from {reads} r) c where substring(sequence, cycle + 1, 1) = 'N'"
BY_CYCLE = f"select file, cycle, tile, count(*) as n_count from ({N_ALL}) n group by 1, 2, 3"
FILL = f"select file, tile, cast(unnest(range(1, last + 1)) as int) as cycle, 0 as n_filler from (select distinct a.file, tile, last from ({N_ALL}) a join (select file, max(cycle) as last from ({N_ALL}) b group by 1) c on a.file = c.file) t"


def _n(spark, d):
    return ncontent.n_positions(view(spark, d, "reads"))


@query(N_ALL)
def n_positions(spark, d):
    return _n(spark, d)


@query("select file from {reads} r where file not like '%L002%' and sequence like '%N%' group by 1")
def n_valid_files(spark, d):
    reads = view(spark, d, "reads").withColumn("name", F.when(F.col("file").contains("L002") & (F.col("pos") % 7 == 0), F.lit("broken")).otherwise(F.col("name")))
    return ncontent.n_reads(reads).select("file").distinct()


@query(f"select file, n_count, count(*) as n_sequences from (select file, tile, x, y, count(*) as n_count from ({N_ALL}) n group by 1, 2, 3, 4) g group by 1, 2")
def n_count_hist(spark, d):
    return ncontent.n_count_histogram(_n(spark, d))


@query(BY_CYCLE)
def n_cycle_tile(spark, d):
    return ncontent.n_by_cycle(_n(spark, d))


@query(FILL)
def n_filler(spark, d):
    return ncontent.filler(_n(spark, d))


@query(f"select coalesce(a.file, b.file) as file, coalesce(a.cycle, b.cycle) as cycle, coalesce(a.tile, b.tile) as tile, coalesce(n_count, 0) as n_count from ({BY_CYCLE}) a full join ({FILL}) b on a.file = b.file and a.cycle = b.cycle and a.tile = b.tile")
def n_cycle_tile_filled(spark, d):
    return ncontent.n_by_cycle_filled(_n(spark, d))


# pattern search

def one_sql(patterns: list[str], errors: int) -> str:
    listed = ", ".join(f"({i}, '{p}')" for i, p in enumerate(patterns, start=1))
    return f"""select read_id, pos, pattern_no, cast(hamming(substring(sequence, p, length(pattern)), pattern) as int) as errors, substring(sequence, p, length(pattern)) as captures from (
        select read_id, pos, sequence, pattern_no, pattern, unnest(range(1, length(sequence) - length(pattern) + 2)) as p from {{reads}} r, (values {listed}) t(pattern_no, pattern)) w
        where hamming(substring(sequence, p, length(pattern)), pattern) <= {errors} qualify row_number() over (partition by read_id, pattern_no order by p) = 1"""


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("captures", F.array_join("captures", " "))


def _found(spark, d, patterns, errors=0, kind="s"):
    return search.matches(view(spark, d, "reads").select("read_id", "pos", "sequence"), patterns, errors, kind)


@query(f"select read_id, captures from ({one_sql(['ACGT'], 0)}) m")
def exact_search(spark, d):
    return _flat(_found(spark, d, ["ACGT"])).select("read_id", "captures")


@query(f"select read_id, errors, captures from ({one_sql(['ACGTAC'], 1)}) m")
def fuzzy_sub1(spark, d):
    return _flat(_found(spark, d, ["ACGTAC"], 1)).select("read_id", "errors", "captures")


@query("""select read_id, cast(e1 + e2 as int) as errors, substring(sequence, p1, 4) || ' ' || substring(sequence, p2, 3) as captures from (
    select *, hamming(substring(sequence, p1, 4), 'ACGT') as e1, hamming(substring(sequence, p2, 3), 'TTA') as e2 from (
      select read_id, sequence, p1, unnest(range(p1 + 4, length(sequence) - 3 + 2)) as p2 from (select read_id, sequence, unnest(range(1, length(sequence) - 4 + 2)) as p1 from {reads} r) a
      where hamming(substring(sequence, p1, 4), 'ACGT') <= 1) b) c
    where e1 + e2 <= 1 qualify row_number() over (partition by read_id order by p1, p2 desc) = 1""")
def fuzzy_dual(spark, d):
    return _flat(_found(spark, d, ["ACGT+TTA"], 1)).select("read_id", "errors", "captures")


#: What lies within one edit of ACGTAC: any of its substitutions, deletions and insertions occurs in the read.
ONE_EDIT = """select distinct e from (select unnest(['ACGTAC']) as e
    union all select substring('ACGTAC', 1, p - 1) || b || substring('ACGTAC', p + 1) from (select unnest(range(1, 7)) as p) p, (select unnest(['A', 'C', 'G', 'T', 'N']) as b) b
    union all select substring('ACGTAC', 1, p - 1) || substring('ACGTAC', p + 1) from (select unnest(range(1, 7)) as p) p
    union all select substring('ACGTAC', 1, p) || b || substring('ACGTAC', p + 1) from (select unnest(range(0, 7)) as p) p, (select unnest(['A', 'C', 'G', 'T', 'N']) as b) b) e"""


@query(f"select distinct read_id, true as within, true as occurs from {{reads}} r join ({ONE_EDIT}) x on contains(sequence, e)")
def fuzzy_edit(spark, d):
    """Reads with a match of any edit; what was matched is within the errors told, and a part of the read."""
    found = _flat(_found(spark, d, ["ACGTAC"], 1, "e"))
    distance = F.levenshtein("captures", F.lit("ACGTAC"))
    return found.select(
        "read_id", ((distance <= F.col("errors")) & (F.col("errors") <= 1)).alias("within"), F.col("sequence").contains(F.col("captures")).alias("occurs"))


@query("""select read_id, regexp_extract(sequence, '([AC]G(T|A)T)', 1) || ' ' || regexp_extract(sequence, '([AC]G(T|A)T)', 2) as captures from {reads} r where regexp_matches(sequence, '[AC]G(T|A)T')""")
def regex_search(spark, d):
    return _flat(_found(spark, d, ["[AC]G(T|A)T"])).select("read_id", "captures")


MANY = one_sql(PATTERNS, 1)
TALLY = f"""select pattern_no, errors, captures, count(*) as cnt, min(pos) as first, count(*) / cast((select count(*) from {{reads}} r) as double) as share from ({MANY}) m group by 1, 2, 3"""
LEVELS = f"""select l.pattern_no, l.errors, coalesce(n, 0) as cnt, coalesce(n, 0) / cast((select count(*) from {{reads}} r) as double) as share from (
    select pattern_no, errors from (values (1), (2), (3)) a(pattern_no), (values (0), (1)) b(errors)) l
    left join (select pattern_no, errors, count(*) as n from ({MANY}) m group by 1, 2) s on l.pattern_no = s.pattern_no and l.errors = s.errors"""


def _tally(spark, d):
    return search.tally(view(spark, d, "reads"), PATTERNS, 1)


def _levels(spark, d):
    counts, total = _tally(spark, d)
    return search.error_totals(counts, len(PATTERNS), 1, total)


@query(f"select read_id, pattern_no, errors, captures from ({MANY}) m")
def multi_pattern(spark, d):
    return _flat(_found(spark, d, PATTERNS, 1)).select("read_id", "pattern_no", "errors", "captures")


@query(f"select pattern_no, errors, captures, cnt, first, round(share, 9) as share from ({TALLY}) t")
def match_counts(spark, d):
    return _flat(_tally(spark, d)[0]).withColumn("share", F.round("share", 9))


@query(f"select pattern_no, errors, cnt, round(share, 9) as share from ({LEVELS}) t")
def error_totals(spark, d):
    return _levels(spark, d).withColumn("share", F.round("share", 9))


@query(f"""select pattern_no, cast(row_number() over (partition by pattern_no order by errors, cnt desc, first, captures) as int) as line_no,
    cast(errors as varchar) || ' ' || captures || ' ' || cast(cnt as varchar) || ' ' || printf('%.2f%%', share * 100) as line from ({TALLY}) t""")
def match_report(spark, d):
    return search.match_report(_tally(spark, d)[0])


@query(f"select pattern_no, errors as line_no, cast(errors as varchar) || ' ' || cast(cnt as varchar) || ' ' || printf('%.2f%%', share * 100) as line from ({LEVELS}) t")
def error_report(spark, d):
    return search.error_report(_levels(spark, d))


EXPANDED = """select 'A.T' as pattern, 'A' || unnest(['A', 'C', 'G', 'T', 'N']) || 'T' as sequence union all select '[ACG]T', unnest(['A', 'C', 'G']) || 'T'
    union all select '(A|C)GT', unnest(['A', 'C']) || 'GT' union all select '(A)?GT', unnest(['A', '']) || 'GT' union all select '(AA|CC)T', unnest(['AA', 'CC']) || 'T'
    union all select 'A..', 'A' || a || unnest(['A', 'C', 'G', 'T', 'N']) from (select unnest(['A', 'C', 'G', 'T', 'N']) as a) x"""


@query(EXPANDED)
def expand_pattern(spark, d):
    return spark.createDataFrame([(p, s) for p in ("A.T", "[ACG]T", "(A|C)GT", "(A)?GT", "(AA|CC)T", "A..") for s in fuzzy.expand(p)], "pattern string, sequence string")


@query("""with e as (select 1 as no, 'A' || unnest(['A', 'C', 'G', 'T', 'N']) || 'GT' as s union all select 2, 'AC' || unnest(['A', 'C']) || 'G' union all select 3, 'TTTT')
    select a.no as a_no, b.no as b_no, cast(min(levenshtein(a.s, b.s)) as int) as distance from e a join e b on a.no < b.no group by 1, 2""")
def pattern_distance(spark, d):
    return search.pattern_distances(spark, ["A.GT", "AC(A|C)G", "TTTT"])


@query("""select cast(row_number() over (order by row_no) as int) as pattern_no, upper(trim(line)) as pattern from (select row_no, case when row_no % 3 = 0 then '  ' else ' ' || index || ' ' end as line from {samples} s) t where trim(line) <> ''""")
def patterns(spark, d):
    lines = view(spark, d, "samples").select("row_no", F.when(F.col("row_no") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("index"), F.lit(" "))).alias("line"))
    from lanewise.sources.text import pattern_lines

    return pattern_lines(lines)


# sheets and masks

@query("""select row_no, line, last_value(case when line like '[%' then line end ignore nulls) over (order by row_no rows between unbounded preceding and current row) as section from {sheet_text} t qualify line <> ''""")
def sheet_sections(spark, d):
    return sheets.sections(view(spark, d, "sheet_text"))


@query("""select cast(row_number() over (order by row_no) as int) as row_no, Lane as "Lane", Sample_ID as "Sample_ID", Sample_Project as "Sample_Project", index, index2 from {samples} s""")
def sheet_rows(spark, d):
    return sheets.data_rows(view(spark, d, "sheet_text")).select("row_no", "Lane", "Sample_ID", "Sample_Project", "index", "index2")


CYCLES_SQL = """select cast(list_position(['R1', 'I1', 'I2', 'R2'], key) as int) as ord, key, cycles from (
    select replace(replace(replace(split_part(line, ',', 1), 'Read', 'R'), 'Index', 'I'), 'Cycles', '') as key, cast(split_part(line, ',', 2) as int) as cycles from (
      select line, last_value(case when line like '[%' then line end ignore nulls) over (order by row_no rows between unbounded preceding and current row) as section from {sheet_text} t) s
    where section = '[Reads]' and line not like '[%' and line <> '') c"""


@query(CYCLES_SQL)
def reads_cycles(spark, d):
    rows = sheets.sections(view(spark, d, "sheet_text")).filter("section = '[Reads]' and line not like '[%'")
    cells = F.split("line", ",")
    key = names.cycle_key(cells[0])
    order = F.array_position(F.array(*map(F.lit, ("R1", "I1", "I2", "R2"))), key).cast("int")
    return rows.select(order.alias("ord"), key.alias("key"), cells[1].cast("int").alias("cycles"))


def masks_sql(source: str) -> str:
    """The cycle numbers of the masks in ``source`` (mask), worked out from their letters and numbers."""
    last = lambda which: f"coalesce(max_by(n, place) filter (where {which}), 0)"
    fields = {"U1": "coalesce(min_by(n, place) filter (where letter = 'U' and n > 0), 0)", "U2": last("letter = 'U' and place > begun")}
    for k in ("R1", "I1", "I2", "R2"):
        fields |= {f"{k}B": last(f"kind = '{k}' and other and place < own"), k: last(f"kind = '{k}' and letter in ('Y', 'I')"), f"{k}A": last(f"kind = '{k}' and other and place > own")}
    return f"""(select mask, {", ".join(f"cast({fields[f]} as int) as {f}" for f in masks.FIELDS)} from (
      select *, coalesce(min(case when letter in ('Y', 'I') and n > 0 then place end) over (partition by mask, kind), 1000000) as own,
        coalesce(min(case when letter = 'U' and n > 0 then place end) over (partition by mask), 1000000) as begun, letter not in ('U', 'Y', 'I') as other from (
        select mask, s * 1000 + t as place, case when contains(segment, 'Y') then 'R' else 'I' end || cast((s - 1) // 2 + 1 as varchar) as kind,
          regexp_extract(token, '^[A-Z]+') as letter, cast(regexp_extract(token, '[0-9]+$') as int) as n from (
          select mask, s, segment, unnest(tokens) as token, generate_subscripts(tokens, 1) as t from (
            select mask, s, segment, regexp_extract_all(segment, '[A-Z]+[0-9]+') as tokens from (
              select mask, unnest(string_split(upper(mask), ';')) as segment, generate_subscripts(string_split(upper(mask), ';'), 1) as s from (select distinct mask from {source}) q0) q1) q2) q3) q4) q5 group by mask) k"""


#: Masks of all kinds of parts, out of the numbers of the suppliers.
SOME_MASKS = """(select case when k % 3 = 0 then 'U' || cast(k % 7 as varchar) else '' end || case when k % 5 = 1 then 'n' || cast(k % 4 as varchar) else '' end || 'Y' || cast(100 + k % 60 as varchar)
    || case when k % 4 = 1 then 'N2' else '' end || case when k % 7 = 3 then 'N1' else '' end
    || case when k % 11 = 0 then '' else ';' || case when k % 6 = 2 then 'N3' else '' end || 'I' || cast(k % 9 as varchar) || case when k % 2 = 0 then 'N1' else '' end || case when k % 8 = 5 then 'U9' else '' end end
    || case when k % 11 < 3 then '' else ';U8;U' || cast(k % 5 as varchar) || 'Y' || cast(90 + k % 30 as varchar) || 'N1' end as mask from (select s_suppkey as k from supplier) s)"""


@query(f"select * from {masks_sql(SOME_MASKS + ' m')}")
def mask_parse(spark, d):
    text = SOME_MASKS.replace("from supplier", f"from parquet.`{d}/supplier.parquet`").replace("varchar", "string")
    return spark.sql(f"select distinct mask from {text} m").select("mask", masks.parse_mask(F.col("mask")).alias("parts")).select("mask", "parts.*")


OWN_MASKS = masks_sql("(select OverrideCycles as mask from {samples} s) m")
CUT = "case when row_no % 5 = 0 then substring(index, 1, 4) else index end"


@query(f"select row_no, length({CUT}) = I1 as one, length(coalesce(index2, '')) = I2 as two from {{samples}} s join {OWN_MASKS} on mask = OverrideCycles")
def mask_check(spark, d):
    s = view(spark, d, "samples").withColumn("index", F.expr(CUT)).withColumn("m", masks.parse_mask(F.col("OverrideCycles")))
    return s.select("row_no", masks.fits(F.col("index"), F.col("m.I1")).alias("one"), masks.fits(F.col("index2"), F.col("m.I2")).alias("two"))


@query(f"select row_no, repeat('N', I1B) || index || repeat('N', I1A) as one, repeat('N', I2B) || coalesce(index2, '') || repeat('N', I2A) as two from {{samples}} s join {OWN_MASKS} on mask = OverrideCycles")
def index_pad(spark, d):
    s = view(spark, d, "samples").withColumn("m", masks.parse_mask(F.col("OverrideCycles")))
    return s.select("row_no", masks.padded(F.col("m.I1B"), F.col("index"), F.col("m.I1A")).alias("one"), masks.padded(F.col("m.I2B"), F.coalesce("index2", F.lit("")), F.col("m.I2A")).alias("two"))


KEY = "Sample_Name || '_S' || cast(row_no as varchar) || '_L' || lpad(Lane, 3, '0') || '_001'"


@query(f"select row_no, {KEY} as sample from {{samples}} s where Sample_Name is not null")
def sample_key(spark, d):
    return sheets.sample_keys(view(spark, d, "samples")).select("row_no", "sample")


MASKS_TABLE = f"""select {KEY} as sample, repeat('N', R1B) as R1B, repeat('N', R1A) as R1A, repeat('N', R2B) as R2B, repeat('N', R2A) as R2A, repeat('N', U1) as U1, repeat('N', U2) as U2,
    repeat('N', I1B) || index || repeat('N', I1A) as I1, repeat('N', I2B) || coalesce(index2, '') || repeat('N', I2A) as I2, R1, R2
    from {{samples}} s join {OWN_MASKS} on mask = OverrideCycles where Sample_Name is not null"""


@query(MASKS_TABLE)
def masks_table(spark, d):
    return sheets.masks_table(view(spark, d, "samples"))


NUMBERED = """select Sample_Project as "Sample_Project", Sample_ID as "Sample_ID", Lane as "Lane", number, index, index2, OverrideCycles as "OverrideCycles" from (
    select s.*, cast(row_number() over (order by project_first, row_no) as int) as number, row_number() over (partition by Sample_Project, Sample_ID order by row_no) as again
    from (select *, min(row_no) over (partition by Sample_Project) as project_first from {samples} s) s) t where again = 1"""


@query(NUMBERED)
def sheet_samples(spark, d):
    return sheets.sample_numbers(view(spark, d, "samples"))


@query(f"""select number, mate, 'Demultiplexing/' || "Sample_Project" || '/' || "Sample_ID" || '/' || "Sample_ID" || '_S' || cast(number as varchar) || '_L' || lpad("Lane", 3, '0') || '_R' || cast(mate as varchar) || '_001.fastq.gz' as path
    from (select *, unnest(case when "OverrideCycles" = 'Y30;I8' then [1] else [1, 2] end) as mate from ({NUMBERED}) n) m""")
def flowcell_paths(spark, d):
    rows = sheets.sample_numbers(view(spark, d, "samples")).withColumn("m", masks.parse_mask(F.col("OverrideCycles")))
    return synth.sample_paths(rows.withColumn("reads", 1 + (F.col("m.R2") > 0).cast("int")))


@query("""select n, cast(max(t) as bigint) as tile_no from (select t, ntile((select count(distinct s_nationkey) from supplier)) over (order by t) - 1 as n from (select unnest(range(0, 128)) as t) r) p group by 1""")
def tile_partition(spark, d):
    some = spark.read.parquet(f"{d}/supplier.parquet").select("s_nationkey").distinct()
    from pyspark.sql import Window

    return synth.sample_tiles(some.select((F.row_number().over(Window.orderBy("s_nationkey")) - 1).cast("bigint").alias("n")))


# rewinding

PAIRS = """select a.lane, a.sample, a.pos, a.name, a.sequence as sequence1, a.quality as quality1, b.sequence as sequence2, b.quality as quality2
    from (select * from {mates} m where mate = 1) a join (select * from {mates} m where mate = 2) b on a.lane = b.lane and a.sample = b.sample and a.pos = b.pos"""
UMI = "case when split_part(name, ' ', 1) like '%+%' then split_part(split_part(name, ' ', 1), ':', 8) else '' end"
MERGED = f"""select sample, lane, pos, name,
    R1B || u1 || sequence1 || R1A || I1 || I2 || R2B || u2 || sequence2 || R2A as sequence,
    repeat('I', length(R1B || u1)) || quality1 || repeat('I', length(R1A || I1 || I2 || R2B || u2)) || quality2 || repeat('I', length(R2A)) as quality
    from (select p.*, t.R1B, t.R1A, t.R2B, t.R2A, t.I1, t.I2, split_part({UMI}, '+', 1) as u1, split_part({UMI}, '+', 2) as u2 from ({PAIRS}) p join ({MASKS_TABLE}) t on p.sample = t.sample) j"""


def _pairs(spark, d):
    return rewind.pair(view(spark, d, "mates"))


def _recipes(spark, d):
    return sheets.masks_table(view(spark, d, "samples"))


@query(PAIRS)
def paired_reads(spark, d):
    return _pairs(spark, d)


@query(f"select p.sample, pos, t.I1, t.I2 from ({PAIRS}) p join ({MASKS_TABLE}) t on p.sample = t.sample")
def recipe_join(spark, d):
    return rewind.with_recipe(_pairs(spark, d), _recipes(spark, d)).select("sample", "pos", "I1", "I2")


@query(f"select m.sample, lane, pos, name, sequence || I1 as sequence, quality || repeat('I', length(I1)) as quality from {{mates}} m join ({MASKS_TABLE}) t on m.sample = t.sample where mate = 1")
def merge_single(spark, d):
    return rewind.merge_single(rewind.with_recipe(view(spark, d, "mates").filter("mate = 1"), _recipes(spark, d)))


@query(MERGED)
def merge_paired(spark, d):
    return rewind.merge_paired(rewind.with_recipe(_pairs(spark, d), _recipes(spark, d)))


@query("select lane, tile // 1000 as surface, tile, count(*) as clusters from {reads} r group by 1, 2, 3")
def tile_bucket_counts(spark, d):
    return view(spark, d, "reads").groupBy("lane", F.floor(F.col("tile") / 1000).alias("surface"), "tile").agg(F.count("*").alias("clusters"))


@query("select distinct lane, tile, x, y from {reads} r")
def tile_positions(spark, d):
    return rewind.tile_positions(view(spark, d, "reads"))


@query("select distinct x + 1 as x, y + 1 as y from {reads} r")
def unique_positions(spark, d):
    return rewind.unique_positions(view(spark, d, "reads"))


@query("""select t.lane, t.tile, p.x + 1 as x, p.y + 1 as y, cast(c.lane is not null as int) as passed from (select distinct x, y from {reads} r) p
    cross join (select distinct lane, tile from {reads} r) t left join (select distinct lane, tile, x, y from {reads} r) c on c.lane = t.lane and c.tile = t.tile and c.x = p.x and c.y = p.y""")
def filter_rows(spark, d):
    reads = view(spark, d, "reads")
    return rewind.filters(reads.select("lane", "tile", "x", "y"), reads)


@query("""select row_number() over (order by y, x) as ord, cast((x - 1000) / 10.0 as float) as lx, cast((y - 1000) / 10.0 as float) as ly from (select distinct x + 1 as x, y + 1 as y from {reads} r) p""")
def locs_rows(spark, d):
    from pyspark.sql import Window

    p = rewind.unique_positions(view(spark, d, "reads"))
    return p.select(F.row_number().over(Window.orderBy("y", "x")).cast("bigint").alias("ord"), rewind.scaled(F.col("x")).alias("lx"), rewind.scaled(F.col("y")).alias("ly"))


@query("""select count(distinct lane) as lanes, count(distinct tile // 1000) as surfaces, count(distinct tile // 100 % 10) as swaths, count(*) as tiles from (select distinct lane, tile from {reads} r) t""")
def flowcell_layout(spark, d):
    return rewind.layout(view(spark, d, "reads").select("lane", "tile"))


@query("select cast(lane as varchar) || '_' || cast(tile as varchar) as name from (select distinct lane, tile from {reads} r) t")
def tile_names(spark, d):
    return rewind.tile_names(view(spark, d, "reads").select("lane", "tile"))


@query("select distinct tile from {reads} r where regexp_full_match(cast(tile as varchar), '[12][1-4][01][0-9]')")
def valid_tiles(spark, d):
    return rewind.valid_tiles(view(spark, d, "reads").select("tile").distinct())


CODE = "(case q when '*' then 1 when '9' then 2 when 'I' then 3 else 0 end * 4 + case b when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end)"
CALLS = "select lane, tile, y, x, pos, cycle, substring(sequence, cycle, 1) as b, substring(quality, cycle, 1) as q from (select *, cast(unnest(range(1, length(sequence) + 1)) as int) as cycle from {reads} r) e"


@query(f"select lane, tile, cycle, count(*) as bases, cast(sum({CODE}) as bigint) as total from ({CALLS}) c group by 1, 2, 3")
def nibble_encode(spark, d):
    calls = view(spark, d, "reads").select("lane", "tile", "sequence", "quality", F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("cycle"))
    code = encode.nibble(F.expr("substring(sequence, cycle, 1)"), F.expr("substring(quality, cycle, 1)"))
    return calls.groupBy("lane", "tile", "cycle").agg(F.count("*").alias("bases"), F.sum(code).alias("total"))


BLOCKS = f"""select lane, tile, cycle, count(*) as clusters, string_agg(substring('0123456789abcdef', {CODE} + 1, 1), '' order by y, x, pos) || case when count(*) % 2 = 1 then '0' else '' end as hex from ({CALLS}) c group by 1, 2, 3"""


def _clusters(spark, d):
    return view(spark, d, "reads").select("lane", "tile", "x", "y", "pos", "sequence", "quality")


@query(BLOCKS)
def cycle_hex(spark, d):
    return rewind.cycle_hex(_clusters(spark, d), CYCLES)


@query(BLOCKS)
def cycle_blocks(spark, d):
    """The packed form, opened again: the same rows as ``cycle_hex``."""

    @F.pandas_udf("string")
    def plain(block: pd.Series) -> pd.Series:
        return block.map(lambda b: gzip.decompress(b).hex())

    blocks = rewind.cycle_blocks(_clusters(spark, d), CYCLES)
    return blocks.select("lane", "tile", "cycle", "clusters", plain("block").alias("hex"))


@query(f"select lane, cast(tile // 1000 as int) as surface, tile, cycle, clusters, cast(length(hex) // 2 as bigint) as usize from ({BLOCKS}) b")
def tile_metrics(spark, d):
    return rewind.tile_metrics(rewind.cycle_blocks(_clusters(spark, d), CYCLES)).drop("csize")


CALLED = "lane long, surface int, tile long, cycle int, clusters long, hex string"


def _decoded(spark, at: str) -> DataFrame:
    """The calls in the cycle files of a folder, by lane, surface, tile and cycle."""

    def opened(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                lane, cycle, surface = map(int, re.search(r"L00(\d)/C(\d+)\.1/L00\d_(\d)\.cbcl$", path).groups())
                rows += [(lane, surface, tile, cycle, n, block.hex()) for tile, (n, block) in encode.read_cbcl(content).items()]
            yield pd.DataFrame(rows, columns=["lane", "surface", "tile", "cycle", "clusters", "hex"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cbcl").load(at)
    return found.select("path", "content").mapInPandas(opened, CALLED)


@query(f"select lane, cast(tile // 1000 as int) as surface, tile, cycle, clusters, hex from ({BLOCKS}) b")
def cbcl_files(spark, d):
    """Cycle files, written and opened again."""
    at = folder(spark)
    files.write_blobs(rewind.cycle_files(rewind.cycle_blocks(_clusters(spark, d), CYCLES)), at)
    return _decoded(spark, at)


RUN_CYCLES = 120
#: Clusters of a whole run: paired ones merged, those of single-end masks with their index.
RUN = f"""select cast(regexp_extract(sample, '_L00([1-9])_', 1) as bigint) as lane, cast(split_part(core, ':', 5) as bigint) as tile, cast(split_part(core, ':', 6) as bigint) as x,
    cast(split_part(core, ':', 7) as bigint) as y, sample || '/' || lpad(cast(row_number() over (partition by sample order by pos) - 1 as varchar), 15, '0') as pos, sequence, quality
    from (select sample, pos, split_part(name, ' ', 1) as core, sequence, quality from (
      select g.sample, pos, name, sequence, quality from ({MERGED}) g join ({MASKS_TABLE}) k on k.sample = g.sample where R2 > 0
      union all select m.sample, pos, name, sequence || I1, quality || repeat('I', length(I1)) from {{mates}} m join ({MASKS_TABLE}) t on m.sample = t.sample where mate = 1 and R2 = 0) a) b"""
RUN_BLOCKS = f"""select lane, cast(tile // 1000 as int) as surface, tile, cycle, count(*) as clusters, string_agg(substring('0123456789abcdef', {CODE} + 1, 1), '' order by y, x, pos) || case when count(*) % 2 = 1 then '0' else '' end as hex
    from (select *, substring(sequence, cycle, 1) as b, substring(quality, cycle, 1) as q from (select *, cast(unnest(range(1, {RUN_CYCLES} + 1)) as int) as cycle from ({RUN}) r) e) c group by 1, 2, 3, 4"""
RUN_PLACES = f"select distinct x + 1 as x, y + 1 as y from ({RUN}) r"
EVERY_TILE = "select l.lane, s * 1000 + w * 100 + n as tile from (select distinct lane from run) l, (select unnest(range(1, 3)) as s) s, (select unnest(range(1, 5)) as w) w, (select unnest(range(1, 17)) as n) n"


def _demultiplexed(spark, d) -> tuple[str, str]:
    """A folder of FASTQ files of named samples, as one would come out of a run, and its sheet."""
    at = folder(spark)
    single = _recipes(spark, d).filter("R2 = 0").select("sample")
    mates = view(spark, d, "mates")
    wanted = mates.filter("mate = 1").unionByName(mates.filter("mate = 2").join(single, "sample", "left_anti"))
    name = F.concat(F.regexp_replace("sample", "_001$", "_R"), F.col("mate").cast("string"), F.lit("_001.fastq.gz"))
    files.write_sequences(wanted.withColumn("file", name), at)
    columns = ["Lane", "Sample_ID", "Sample_Name", "Sample_Project", "index", "index2", "OverrideCycles"]
    rows = [[r[c] or "" for c in columns] for r in view(spark, d, "samples").filter("row_no > 0").orderBy("row_no").collect()]
    reads = "[Reads]\nRead1Cycles,32\nIndex1Cycles,8\nIndex2Cycles,8\nRead2Cycles,32\n"
    return at, reads + "[BCLConvert_Data]\n" + "".join(",".join(r) + "\n" for r in [columns, *rows])


def _rewound(spark, d) -> str:
    """The folder of a run's files, out of its FASTQ files."""
    source, sheet = _demultiplexed(spark, d)
    out = folder(spark)
    runs.rewind_run(spark, source, out, sheet, RUN_CYCLES, day=datetime(2024, 3, 5))
    return out


@query(f"""with run as ({RUN}) select 'Data/Intensities/BaseCalls/L00' || cast(lane as varchar) || '/C' || cast(c as varchar) || '.1/L00' || cast(lane as varchar) || '_' || cast(s as varchar) || '.cbcl' as path
      from (select distinct lane, tile // 1000 as s from run) r, (select unnest(range(1, {RUN_CYCLES} + 1)) as c) c
    union all select 'Data/Intensities/BaseCalls/L00' || cast(lane as varchar) || '/s_' || cast(lane as varchar) || '_' || cast(tile as varchar) || '.filter' from ({EVERY_TILE}) t
    union all select unnest(['Data/Intensities/s.locs', 'RunInfo.xml', 'SampleSheet.csv'])""")
def rewind_files(spark, d):
    """The whole way from FASTQ files to the files of the instrument: their paths."""
    out = _rewound(spark, d)
    base = out.removeprefix("file:").rstrip("/") + "/"
    return spark.createDataFrame([(p.removeprefix("file:").split(base, 1)[-1],) for p in files.listed(out, "*")], "path string")


@query(RUN_BLOCKS)
def rewind_cycles(spark, d):
    return _decoded(spark, _rewound(spark, d))


@query(f"select row_number() over (order by y, x) as ord, cast((x - 1000) / 10.0 as float) as lx, cast((y - 1000) / 10.0 as float) as ly from ({RUN_PLACES}) p")
def rewind_positions(spark, d):
    out = _rewound(spark, d)
    content = spark.read.format("binaryFile").load(f"{out}/Data/Intensities/s.locs").first()["content"]
    return spark.createDataFrame([(n, *p) for n, p in enumerate(encode.read_positions(bytes(content)), start=1)], "ord long, lx float, ly float")


@query(f"""with run as ({RUN}), places as (select distinct x, y from run), has as (select distinct lane, tile, x, y from run)
    select t.lane, t.tile, count(*) as positions, cast(count(h.x) as bigint) as passed, md5(string_agg(case when h.x is null then '0' else '1' end, '' order by p.y, p.x)) as bits
    from ({EVERY_TILE}) t cross join places p left join has h on h.lane = t.lane and h.tile = t.tile and h.x = p.x and h.y = p.y group by 1, 2""")
def rewind_filters(spark, d):
    def opened(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                lane, tile = map(int, re.search(r"s_(\d)_(\d+)\.filter$", path).groups())
                bits = "".join(map(str, encode.read_filter(content)))
                rows.append((lane, tile, len(bits), bits.count("1"), md5(bits.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["lane", "tile", "positions", "passed", "bits"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.filter").load(_rewound(spark, d))
    return found.select("path", "content").mapInPandas(opened, "lane long, tile long, positions long, passed long, bits string")


@query("select lane, sample, pos, name from {mates} m where mate = 1 order by lane, sample, pos limit 1")
def first_read(spark, d):
    return rewind.first_read(view(spark, d, "mates").filter("mate = 1").select("lane", "sample", "pos", "name"))


@query(f"select cast(row_number() over (order by ord) as int) as number, key, cycles, case when key like 'R%' then 'N' else 'Y' end as is_index from ({CYCLES_SQL}) c where cycles > 0")
def runinfo_reads(spark, d):
    return rewind.run_info_reads(reads_cycles(spark, d))


# files, generators, trees

@query("""select regexp_extract(file, '[^/]+$') as file, row_number() over (partition by file order by pos) - 1 as pos, name, sequence, quality from {reads} r""")
def fastq_scan(spark, d):
    at = folder(spark)
    files.write_sequences(view(spark, d, "reads"), at)
    return files.read_sequences(spark, at, "*.fastq.gz").withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("""select replace(regexp_extract(file, '[^/]+$'), '.fastq.gz', '.fasta') as file, row_number() over (partition by file order by pos) - 1 as pos, name, sequence, cast(null as varchar) as quality from {reads} r""")
def fasta_scan(spark, d):
    at = folder(spark)
    files.write_sequences(view(spark, d, "reads").withColumn("file", F.replace("file", F.lit(".fastq.gz"), F.lit(".fasta"))), at, "fasta")
    return files.read_sequences(spark, at, "*.fasta").withColumn("file", F.element_at(F.split("file", "/"), -1))


@query("select unnest(range(0, 1000)) as id, 12 as size, 1 as times")
def gen_distinct(spark, d):
    rows = synth.sequences(spark, 1000, 12, seed=3)
    from pyspark.sql import Window

    return rows.select("id", F.length("sequence").alias("size"), F.count("*").over(Window.partitionBy("sequence")).cast("int").alias("times"))


@query(f"""select cast(n.number as bigint) as n, mate, 50 as reads, case when mate = 1 then R1 else R2 end as size, 50 as places, 50 as named from (
      select *, unnest([1, 2]) as mate from ({NUMBERED}) n join {OWN_MASKS} on mask = "OverrideCycles") n where case when mate = 1 then R1 else R2 end > 0""")
def gen_reads(spark, d):
    """Generated reads of each sample and mate: their number, length, different positions, and how many names have the form their recipe asks for."""
    rows = sheets.sample_numbers(view(spark, d, "samples")).withColumn("m", masks.parse_mask(F.col("OverrideCycles")))
    extension = names.read_extension(F.col("index"), F.col("index2"), True)
    samples = rows.select(
        F.col("number").alias("n"), F.concat(F.lit("VH1:1:FC1:"), F.col("Lane")).alias("prefix"), F.lit(1101).alias("tile"), extension.alias("extension"), "m.R1", "m.R2", "m.U1", "m.U2")
    made = synth.sample_reads(samples, 50, seed=4).join(samples.select("n", "prefix", "extension", "U1", "U2"), "n")
    parts = F.split(F.split_part("name", F.lit(" "), F.lit(1)), ":")
    umi = F.coalesce(F.get(parts, F.lit(7)), F.lit(""))
    size = F.col("U1") + F.col("U2") + F.when((F.col("U1") > 0) & (F.col("U2") > 0), 1).otherwise(0)
    end = F.regexp_replace("extension", "^ 1", F.concat(F.lit(" "), F.col("mate").cast("string")))
    fits = F.col("name").startswith(F.concat("prefix", F.lit(":1101:"))) & F.col("name").endswith(end) & (F.length(umi) == size) & umi.rlike("^[ACGT]*([+][ACGT]+)?$")
    one = made.withColumns({"x": F.get(parts, F.lit(5)), "y": F.get(parts, F.lit(6)), "fits": fits & F.col("sequence").rlike("^[ACGT]+$") & (F.length("quality") == F.length("sequence"))})
    return one.groupBy(F.col("n").cast("bigint").alias("n"), "mate").agg(
        F.count("*").cast("int").alias("reads"), F.max(F.length("sequence")).alias("size"), F.countDistinct("x", "y").cast("int").alias("places"), F.sum(F.col("fits").cast("int")).cast("int").alias("named"))


@query("select cast(unnest(range(0, 5)) as int) as seed, true as formed, true as again")
def flowcell_id(spark, d):
    rows = spark.createDataFrame([(n, synth.flowcell_id(n), synth.flowcell_id(n)) for n in range(5)], "seed int, one string, two string")
    return rows.select("seed", F.col("one").rlike("^[0-9]{2}[A-Z]{6}[0-9]$").alias("formed"), (F.col("one") == F.col("two")).alias("again"))


LISTING = ("mydir\tdir", "", "mydir/subdir\tdir", "mydir/hello.txt\tfile", "mydir/plain", "mydir/a.b", "mydir/.DS_Store", "mydir/x.y\tdir", "mydir/z\tlink")


def _listing(spark):
    return spark.createDataFrame(list(enumerate(LISTING, start=1)), "ord long, line string")


LISTED = ", ".join("(" + str(n) + ", '" + line.replace("\t", "' || chr(9) || '") + "')" for n, line in enumerate(LISTING, start=1))


@query(f"""select cast(ord as bigint) as ord, path, case when tag in ('dir', 'file') then tag when last = '.DS_Store' or regexp_full_match(last, '.+[.][^.]+') then 'file' else 'dir' end as kind from (
    select *, list_extract(string_split(path, '/'), -1) as last from (select ord, trim(split_part(line, chr(9), 1)) as path, nullif(trim(split_part(line, chr(9), 2)), '') as tag from (values {LISTED}) t(ord, line) where trim(line) <> '') a) b""")
def dir_parse(spark, d):
    return tree.parse(_listing(spark))


@query("""select path, case when regexp_matches(path, '[.][a-z]$') then 'file' else 'dir' end as kind from (select 'd' || cast(s_suppkey as varchar) || case when s_suppkey % 2 = 0 then '.t' else '' end as path from supplier) s""")
def dir_kind(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    path = F.concat(F.lit("d"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".t").otherwise(""))
    return s.select(path.alias("path"), tree.kind_of(path, F.lit(None).cast("string")).alias("kind"))


@query("""select cast(ord as bigint) as ord, path, kind from (values (1, 'mydir', 'dir'), (2, 'mydir/.DS_Store', 'file'), (3, 'mydir/a.b', 'file'), (4, 'mydir/hello.txt', 'file'), (5, 'mydir/plain', 'dir'), (6, 'mydir/subdir', 'dir'), (7, 'mydir/x.y', 'dir'), (8, 'mydir/z', 'dir')) t(ord, path, kind)""")
def dir_extract(spark, d):
    at = folder(spark).removeprefix("file:")
    tree.create(tree.parse(_listing(spark)), at)
    return tree.extract(spark, f"{at}/mydir")
