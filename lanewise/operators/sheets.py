"""Sectioned sample sheets as DataFrames, and what the rewinding of a run takes from them."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import masks, names
from lanewise.operators import drift
from lanewise.schema import SHEET

DATA_MARKERS = ("[Data]", "[BCLConvert_Data]")
#: The section that sheets of the second version have; those of the first name cycles in ``Recipe`` and the flowcell in ``FCID``.
SECOND = "[BCLConvert_Data]"
REQUIRED = ("Lane", "Sample_Project", "index")


def sections(lines: DataFrame) -> DataFrame:
    """``row_no``, ``line``, ``section``: the section that each line of a sheet lies in (null before the first).

    One sheet is one ordered text of bounded size, so a single window runs over its lines; a
    table of many sheets goes through ``drift.data_sections`` instead.
    """
    label = F.nullif(F.regexp_extract("line", r"^\s*(\[[^\]]+\])", 1), F.lit(""))
    return lines.select("row_no", "line", F.last(label, ignorenulls=True).over(Window.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)).alias("section")).filter("line <> ''")


def named_rows(lines: DataFrame, columns: tuple[str, ...], required: tuple[str, ...] = ()) -> DataFrame:
    """Data rows of many sheets: ``sheet_id``, ``line_no`` and ``columns``, each found by its header.

    ``lines``: sheet_id, line_no, line. Of equal headers the first counts; cells are taken
    without quotes and outer blanks, empty ones and those of headers that a sheet lacks are
    null. Sheets without data section, or without one of the ``required`` headers, give no rows.
    """
    read = drift.data_sections(lines)
    slots = read.columns.groupBy("sheet_id", "head_no", "end").agg(F.map_from_entries(F.collect_list(F.struct("field", "pos"))).alias("slots"))
    for c in required:
        slots = slots.filter(F.map_contains_key("slots", F.lit(c)))
    cell = lambda c: F.nullif(drift.clean(F.get("parts", F.try_element_at("slots", F.lit(c)))), F.lit("")).alias(c)
    return read.rows(slots).select("sheet_id", "line_no", *[cell(c) for c in columns])


def data_rows(lines: DataFrame) -> DataFrame:
    """The data rows of one sheet (``row_no``, ``line``) with the schema SHEET, found by their headers and numbered from 1."""
    rows = named_rows(lines.select(F.lit(0).alias("sheet_id"), F.col("row_no").alias("line_no"), "line"), tuple(SHEET.names[1:]))
    return rows.select(F.row_number().over(Window.orderBy("line_no")).alias("row_no"), *SHEET.names[1:])


def read_section(text: str, markers: tuple[str, ...]) -> tuple[list[str], list[list[str]]]:
    """Header and rows of the first of the sections ``markers`` in a sheet's text; ends at the next section."""
    inside, header, rows = False, [], []
    for cells in csv.reader(text.lstrip("﻿").splitlines()):
        first = cells[0].strip() if cells else ""
        if first in markers:
            inside = True
        elif first.startswith("["):
            if inside:
                break
        elif inside and any(c.strip() for c in cells):
            if header:
                rows.append(cells)
            else:
                header = [c.strip() for c in cells]
    if not inside:
        raise ValueError(f"the sheet has no section {' or '.join(markers)}")
    return header, rows


def read_sheet(spark: SparkSession, text: str, markers: tuple[str, ...] = DATA_MARKERS, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The data rows of one sheet with the fixed schema SHEET; columns it lacks are null.

    Raises ValueError without a data section, a required column or any row.
    """
    header, rows = read_section(text, markers)
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"sample sheet without required columns: {', '.join(missing)}")
    if not rows:
        raise ValueError("the sheet names no samples")
    at = {c: header.index(c) for c in SHEET.names[1:] if c in header}
    cell = lambda r, c: r[at[c]] if c in at and at[c] < len(r) else None
    return spark.createDataFrame([(n, *[cell(r, c) for c in SHEET.names[1:]]) for n, r in enumerate(rows, start=1)], SHEET)


def generator_sheet(spark: SparkSession, text: str) -> tuple[DataFrame, str | None]:
    """The samples of a sheet of either version, with their mask in OverrideCycles; and the flowcell, which the first version names.

    A recipe such as ``151-10-10-151`` has cycles of reads only, of which the last number counts
    for the single segment that the mask then has. ValueError if there are several flowcells.
    """
    if any(line.strip().startswith(SECOND) for line in text.splitlines()):
        return read_sheet(spark, text, required=("Lane", "Sample_ID", "Sample_Project", "OverrideCycles")), None
    rows = read_sheet(spark, text, required=("Lane", "Sample_ID", "Sample_Project", "Recipe", "FCID"))
    cells = [r[0] for r in rows.select("FCID").distinct().limit(2).collect()]
    if len(cells) > 1:
        raise ValueError("the sheet names several flowcells")
    return rows.withColumn("OverrideCycles", F.concat(F.lit("Y"), F.replace("Recipe", F.lit("-"), F.lit("Y")))), cells[0]


def read_cycles(text: str) -> dict[str, int]:
    """Cycles of each read of a sheet's ``[Reads]``, in the order R1, I1, I2, R2."""
    first, rows = read_section(text, ("[Reads]",))
    named = {r[0].strip(): int(r[1]) for r in [first, *rows]}
    keys = {k.replace("Read", "R").replace("Index", "I").replace("Cycles", ""): v for k, v in named.items()}
    return {k: keys[k] for k in ("R1", "I1", "I2", "R2") if k in keys}


def mixing_sheet(sheet: DataFrame) -> DataFrame:
    return sheet.select(names.lane_name(F.col("Lane")).alias("Lane"), "Sample_Project", F.col("index").alias("index1"), "index2")


def sample_keys(sheet: DataFrame) -> DataFrame:
    """``sample``: name, number of its row in the sheet and lane, for rows that have a name."""
    key = F.concat_ws("_", "Sample_Name", F.concat(F.lit("S"), F.col("row_no").cast("string")), names.lane_name(F.col("Lane")), F.lit("001"))
    return sheet.filter("Sample_Name is not null").withColumn("sample", key)


def masks_table(sheet: DataFrame, strict: bool = True) -> DataFrame:
    """What each sample's reads are padded with: ``sample`` and the texts and lengths of its mask.

    With ``strict`` an index whose length isn't the mask's raises, otherwise its row is left out.
    """
    rows = sample_keys(sheet).withColumn("m", masks.parse_mask(F.col("OverrideCycles")))
    if not strict:
        rows = rows.filter(masks.fits(F.col("index"), F.col("m.I1")) & masks.fits(F.col("index2"), F.col("m.I2")))
    n = lambda f: F.repeat(F.lit("N"), F.col(f"m.{f}"))
    one = masks.checked(F.col("index"), F.col("m.I1"), "Index 1")
    two = masks.checked(F.col("index2"), F.col("m.I2"), "Index 2")
    return rows.select(
        "sample", n("R1B").alias("R1B"), n("R1A").alias("R1A"), n("R2B").alias("R2B"), n("R2A").alias("R2A"), n("U1").alias("U1"), n("U2").alias("U2"),
        masks.padded(F.col("m.I1B"), one, F.col("m.I1A")).alias("I1"), masks.padded(F.col("m.I2B"), two, F.col("m.I2A")).alias("I2"),
        F.col("m.R1").alias("R1"), F.col("m.R2").alias("R2"))


def sample_numbers(sheet: DataFrame) -> DataFrame:
    """Samples by project in order of first appearance, numbered by row; the first row of a (project, sample) counts."""
    first = sheet.groupBy("Sample_Project", "Sample_ID").agg(F.min("row_no").alias("row_no"))
    seen = sheet.groupBy("Sample_Project").agg(F.min("row_no").alias("project_first"))
    rows = sheet.join(seen, "Sample_Project").withColumn("number", F.row_number().over(Window.orderBy("project_first", "row_no")))
    return rows.join(first, ["Sample_Project", "Sample_ID", "row_no"], "left_semi").select("Sample_Project", "Sample_ID", "Lane", "number", "index", "index2", "OverrideCycles")
