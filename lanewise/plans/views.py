"""Reads, sheets and samples derived from the driver's tables, alike in both engines.

Each view is an SQL text over the tables' names; ``string`` stands for the text type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIGITS = "'0123456789abcdef', 'ACGTACGTACGTACGT'"

READS = f"""
select event_id as read_id, lane, tile, x, y, idx1 || '+' || idx2 as idx, sequence, quality,
       'VH00001:1:AABCCC:' || cast(lane as string) || ':' || cast(tile as string) || ':' || cast(x as string) || ':' ||
       cast(y as string) || ' 1:N:0:' || idx1 || '+' || idx2 as name,
       'Undetermined_S0_L' || lpad(cast(lane as string), 3, '0') || '_R1_001.fastq.gz' as file, event_id as pos
from (select event_id, (user_id + event_id) % 4 + 1 as lane,
             (event_id % 2 + 1) * 1000 + (event_id % 4 + 1) * 100 + (event_id % 16 + 1) as tile,
             1000 + (event_id * 7) % 2201 as x, 1000 + (event_id * 13) % 601 as y,
             case when event_id % 11 = 0 then 'GGGGGGGG'
                  when event_id % 5 = 0 then 'A' || substring(i, 2, 7)
                  else substring(i, 1, 8) end as idx1,
             substring(i, 9, 8) as idx2,
             translate(md5(cast(event_id as string)), '0123456789abcdef', 'ACGTACGTACGTACGN') as sequence,
             translate(md5('q' || cast(event_id as string)), '0123456789abcdef', '!*9I!*9I!*9I!*9#') as quality
      from (select *, translate(md5(cast(user_id % 100 as string)), {DIGITS}) as i from events) e) r
"""

SHEET = f"""
select 'L' || lpad(cast(lane as string), 3, '0') as Lane, 'Project_' || cast(s_nationkey as string) as Sample_Project,
       substring(i, 1, 8) as index1, case when s_suppkey % 7 = 0 then null else substring(i, 9, 8) end as index2
from (select s_suppkey, s_nationkey, s_suppkey % 4 + 1 as lane, translate(md5(cast(s_suppkey as string)), {DIGITS}) as i from supplier
      union all
      select s_suppkey, s_nationkey, (s_suppkey + 1) % 4 + 1 as lane, translate(md5(cast(s_suppkey as string)), {DIGITS}) as i
      from supplier where s_suppkey % 10 = 0) z
"""

#: Rows of a demultiplexing sheet, numbered from 1; every ninth has no name.
SAMPLES = f"""
select s_suppkey as row_no, cast(s_suppkey % 4 + 1 as string) as Lane, 'SMP' || cast(s_suppkey % 90 as string) as Sample_ID,
       case when s_suppkey % 9 = 0 then null else 'name' || cast(s_suppkey as string) end as Sample_Name,
       'Project_' || cast(s_nationkey as string) as Sample_Project,
       substring(i, 1, 8) as index, case when s_suppkey % 6 in (1, 3) then null else substring(i, 9, 8) end as index2,
       case s_suppkey % 6 when 0 then 'Y28;I8;I8;Y28' when 1 then 'Y30;I8' when 2 then 'U4Y28;I8N2;N1I8;U3Y26N1'
            when 3 then 'N1Y30;I8;Y31' when 4 then 'N1Y20;I8;I8U9;U8N2Y16N1' else 'Y32;I8;I8;Y32' end as OverrideCycles
from (select *, translate(md5(cast(s_suppkey as string)), {DIGITS}) as i from supplier) s
"""

#: A sheet as lines of text, with sections before and after the data.
SHEET_TEXT = f"""
select row_no, line from (
  select cast(1 as bigint) as row_no, '[Header]' as line union all select 2, 'FileFormatVersion,2' union all select 3, '' union all
  select 4, '[Reads]' union all select 5, 'Read1Cycles,151' union all select 6, 'Index1Cycles,10' union all select 7, 'Index2Cycles,8' union all
  select 8, 'Read2Cycles,151' union all select 9, '[BCLConvert_Data]' union all select 10, 'Lane,Sample_ID,Sample_Project,index,index2' union all
  select 11 + row_no, Lane || ',' || Sample_ID || ',' || Sample_Project || ',' || index || ',' || coalesce(index2, '') from ({SAMPLES}) s union all
  select 100000000, '[Cloud_Settings]' union all select 100000001, 'GeneratedVersion,1.0') t
"""

#: Paired reads of named samples: the mates of a pair share lane, sample and position.
MATES = f"""
select lane, 'name' || cast(m as string) || '_S' || cast(m as string) || '_L00' || cast(m % 4 + 1 as string) || '_001' as sample, pos, mate,
       'VH00001:1:AABCCC:' || cast(lane as string) || ':' || cast(tile as string) || ':' || cast(x as string) || ':' || cast(y as string) ||
       case m % 6 when 4 then ':ACGTACGTA+TTTTCCCC' when 2 then ':ACGT+GGG' else '' end || ' ' || cast(mate as string) || ':N:0:' || idx as name,
       case when mate = 1 then sequence else reverse(sequence) end as sequence, case when mate = 1 then quality else reverse(quality) end as quality
from (select *, read_id % 10 + 1 as m, 1 as mate from ({READS}) r1 union all select *, read_id % 10 + 1 as m, 2 as mate from ({READS}) r2) a
"""

VIEWS = {"reads": READS, "sheet": SHEET, "samples": SAMPLES, "sheet_text": SHEET_TEXT, "mates": MATES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    for t in ("events", "supplier"):
        text = text.replace(f"from {t}", f"from parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text)


def sql(text: str) -> str:
    """An SQL text with ``{reads}`` and so on replaced by the views, for the other engine."""
    for name, body in VIEWS.items():
        text = text.replace("{" + name + "}", f"({body})")
    return text.replace(" as string)", " as varchar)")
