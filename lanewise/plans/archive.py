"""Queries over the read archive and the sample sheets as delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators import drift, rejects
from lanewise.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_rejects(spark, sf_dir).select("raw_id")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.judge(table(spark, sf_dir, "raw_reads")).filter("reason is not null").select("raw_id", "line", "reason")


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.typed(rejects.judge(table(spark, sf_dir, "raw_reads")), ["raw_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("sheet_id", "field", "change")


def p5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).withColumn("issued_at", F.unix_micros("issued_at")).withColumnRenamed("issued_at", "issued_us")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "sheet_lines"), table(spark, sf_dir, "sheet_files"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.sample_rows(table(spark, sf_dir, "sheet_lines"), table(spark, sf_dir, "sheet_files"))


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row of the common table holds, whatever its columns are called: to be compared with the lines themselves."""
    rows = p5_rows(spark, sf_dir)
    kinds = dict(rows.dtypes[2:])
    numbers = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c, k in kinds.items() if k != "string"]
    texts = F.filter(F.array(*[F.col(f"`{c}`") for c, k in kinds.items() if k == "string"]), lambda c: c.isNotNull())
    plain = lambda c: c.rlike(r"^[0-9]+(\.[0-9]+)?\z")
    total = F.aggregate(F.filter("texts", plain), F.lit(0.0), lambda a, c: a + c.cast("double"))
    count = F.size("texts")
    for c, k in kinds.items():
        if k != "string":
            count = count + F.col(f"`{c}`").isNotNull().cast("int")
    for n in numbers:
        total = total + n
    return rows.withColumn("texts", texts).select(
        "sheet_id", "line_no", "Sample_ID", count.cast("bigint").alias("cells"), F.round(total, 4).alias("numbers"),
        F.array_join(F.array_sort(F.filter("texts", lambda c: ~plain(c))), "|").alias("words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_rows, p5_found, p5_changes, p5_rows, p5_cells)}

FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
FIVE = ",".join([f"({FIELD})"] * 5)
BARCODE = r"[ACGTN]+(\+[ACGTN]+)?"
REJECTS = f"""
with f as (select raw_id, line, regexp_full_match(line, '{FIELD}(,{FIELD})*') as quoted, regexp_full_match(line, '{FIVE}') as five,
                  [{", ".join(f"regexp_extract(line, '^{FIVE}$', {n})" for n in range(1, 5))}] as raw from raw_reads),
v as (select *, [case when starts_with(x, '"') then replace(substring(x, 2, length(x) - 2), '""', '"') else x end for x in raw] as v from f)
select raw_id, line, case when line is null then 'columns' when not quoted then 'quoting' when not five then 'columns' else 'value' end as reason
from v where line is null or not quoted or not five or not (
  regexp_full_match(v[1], '[0-9]+') and regexp_full_match(v[2],
    '[A-Za-z0-9]{{3,}}:[0-9]+:[A-Za-z0-9]+:[1-8]:[12][1-4][01][0-9]:[0-9]+:[0-9]+(:{BARCODE})? [12]:[YN]:[0-9]+:{BARCODE}')
  and regexp_full_match(v[3], '[ACGTN]+') and regexp_full_match(v[4], '[!-~]*') and length(v[3]) = length(v[4]))
"""
def part(side: int, field: int, kind: str = "varchar") -> str:
    """A field of the name, before (1) or after (2) its blank."""
    return f"cast(split_part(split_part(v[2], ' ', {side}), ':', {field}) as {kind})"


ROWS = f"""
with f as (select raw_id, [{", ".join(f"regexp_extract(line, '^{FIVE}$', {n})" for n in range(1, 6))}] as raw from raw_reads where raw_id not in (select raw_id from ({REJECTS}) r)),
v as (select raw_id, [case when starts_with(x, '"') then replace(substring(x, 2, length(x) - 2), '""', '"') else x end for x in raw] as v from f)
select raw_id, cast(v[1] as decimal(38, 0)) as read_no, v[2] as name, {part(1, 1)} as instrument, {part(1, 2, "bigint")} as run, {part(1, 3)} as flowcell,
  {part(1, 4, "int")} as lane, {part(1, 5, "int")} as tile, {part(1, 6, "bigint")} as x, {part(1, 7, "bigint")} as y, nullif({part(1, 8)}, '') as umi,
  {part(2, 1, "int")} as read, {part(2, 2)} as filtered, {part(2, 3, "bigint")} as control, {part(2, 4)} as barcode, v[3] as sequence, v[4] as quality, v[5] as sample
from v
"""
BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(65279)"
CELLS = f"""
with outer_ as (select distinct sheet_id, line_no, [trim(c, {BLANK}) for c in regexp_extract_all(',' || line, ',(\\s*"(?:[^"]|"")*"\\s*|[^,]*)', 1)] as c
  from sheet_lines where sheet_id is not null and line_no is not null and line is not null),
p as (select sheet_id, line_no, [case when length(x) >= 2 and starts_with(x, '"') and ends_with(x, '"') then trim(replace(substring(x, 2, length(x) - 2), '""', '"'), {BLANK}) else x end for x in c] as c from outer_),
q as (select *, starts_with(c[1], '[') and ends_with(c[1], ']') as mark from p where len(list_filter(c, lambda x: x <> '')) > 0),
w as (select *, sum(cast(mark as int)) over (partition by sheet_id order by line_no) as section from q),
d as (select sheet_id, min(section) as section from w where mark and c[1] in ('[Data]', '[BCLConvert_Data]') group by 1),
inside as (select w.*, row_number() over (partition by w.sheet_id order by line_no) as n from w join d on w.sheet_id = d.sheet_id and w.section = d.section where not mark),
head as (select sheet_id, c as header from inside where n = 1),
f as (select sheet_id, header, header[pos] as field, pos from (select *, unnest(range(1, len(header) + 1)) as pos from head) h where header[pos] <> '' and list_position(header, header[pos]) = pos),
cell as (select f.sheet_id, i.line_no, f.field, coalesce(i.c[f.pos], '') as v, coalesce(i.c[list_position(f.header, 'Sample_ID')], '') as sample
  from f join inside i on i.sheet_id = f.sheet_id and i.n > 1)
"""
CHANGES = f"""{CELLS},
kind as (select f.sheet_id, f.field, max(case when regexp_full_match(v, '[0-9]+') then 0 when regexp_full_match(v, '[0-9]+[.][0-9]+') then 1 when v <> '' then 2 end) as k
  from f left join cell on f.sheet_id = cell.sheet_id and f.field = cell.field where f.field <> 'Sample_ID' group by 1, 2),
pairs as (select * from (select sheet_id, instrument, issued_at, lag(sheet_id) over (partition by instrument order by issued_at) as previous from sheet_files) l where previous is not null),
now_ as (select pairs.sheet_id, previous, field, k from pairs join kind on kind.sheet_id = pairs.sheet_id),
then_ as (select pairs.sheet_id, previous, field, k from pairs join kind on kind.sheet_id = pairs.previous),
new as (select n.* from now_ n where not exists (select 1 from then_ t where t.sheet_id = n.sheet_id and t.field = n.field)),
gone as (select t.* from then_ t where not exists (select 1 from now_ n where t.sheet_id = n.sheet_id and t.field = n.field)),
held as (select sheet_id, field, sample, list_sort(list(distinct v)) as held from cell where sample <> '' group by 1, 2, 3),
named as (select new.sheet_id, new.field, gone.field as old from new join gone on new.sheet_id = gone.sheet_id
  join held a on a.sheet_id = new.sheet_id and a.field = new.field join held b on b.sheet_id = gone.previous and b.field = gone.field and a.sample = b.sample
  group by 1, 2, 3 having bool_and(a.held = b.held) and bool_or(a.held <> [''])),
told as (select sheet_id, field, 'renamed' as change, min(old) as before, field as after from named group by 1, 2
union all select sheet_id, field, 'added', null, null from new where not exists (select 1 from named m where m.sheet_id = new.sheet_id and m.field = new.field)
union all select sheet_id, field, 'removed', null, null from gone where not exists (select 1 from named m where m.sheet_id = gone.sheet_id and m.old = gone.field)
union all select n.sheet_id, n.field, 'retyped', ['integer', 'decimal', 'text'][t.k + 1], ['integer', 'decimal', 'text'][n.k + 1] from now_ n join then_ t on n.sheet_id = t.sheet_id and n.field = t.field where n.k <> t.k)
"""
ROW_CELLS = f"""{CELLS}
select sheet_id, line_no, max(sample) as "Sample_ID", count(*) as cells, round(coalesce(sum(case when regexp_full_match(v, '[0-9]+([.][0-9]+)?') then try_cast(v as double) end), 0), 4) as numbers,
  coalesce(string_agg(v, '|' order by v) filter (where not regexp_full_match(v, '[0-9]+([.][0-9]+)?')), '') as words
from cell where v <> '' group by 1, 2
"""
ORACLE = {
    "p1_found": f"select raw_id from ({REJECTS})", "p1_rejects": REJECTS, "p1_rows": ROWS, "p5_cells": ROW_CELLS,
    "p5_found": f"{CHANGES} select sheet_id, field, change from told",
    "p5_changes": f"{CHANGES} select told.sheet_id, instrument, epoch_us(issued_at) as issued_us, previous, field, change, before, after from told join pairs on told.sheet_id = pairs.sheet_id",
}
