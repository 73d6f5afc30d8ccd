"""Sample sheets whose columns drift: one table of all sample rows, and a report of each change."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.runtime import checkpointed

DATA_SECTIONS = ("[Data]", "[BCLConvert_Data]")
KEY = "Sample_ID"
#: The lattice of types, each wider than those before it; a column without values has none.
TYPES = ("integer", "decimal", "text")
#: Names that stand for their column if several are in use; else the first by the alphabet.
PREFERRED = ("Lane", "Sample_ID", "Sample_Name", "index", "index2", "Sample_Project", "OverrideCycles")
#: Different headers that a wide table may have; the driver handles their names.
MOST_HEADERS = 2_000
#: Parts into which the lines of a sheet are spread when they meet its borders.
SALTS = 8
#: Digits that a bigint surely holds.
DIGITS = 18
CELL = r',(\s*+"[^"]*+(?:""[^"]*+)*+"\s*+(?=,|\z)|[^,]*+)'
BLANKS = " \t\r\n ﻿"


def clean(cell: Column) -> Column:
    """A cell without outer blanks and enclosing quotes."""
    outer = F.btrim(cell, F.lit(BLANKS))
    quoted = (F.length(outer) >= 2) & outer.startswith('"') & outer.endswith('"')
    return F.when(quoted, F.btrim(F.replace(outer.substr(F.lit(2), F.length(outer) - 2), F.lit('""'), F.lit('"')), F.lit(BLANKS))).otherwise(outer)


def parts(line: Column) -> Column:
    """The cells of a line as written. The comma put before it keeps every match from being empty."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))


def cells(line: Column) -> Column:
    return F.transform(parts(line), clean)


def has_content(line: Column) -> Column:
    """Whether some cell isn't empty; nearly always settled without parsing the line."""
    return line.rlike('[^,"\\s\ufeff\u00a0]') | F.exists(cells(line), lambda c: c != "")


def level(cell: Column) -> Column:
    """Place of a cell in TYPES, null for an empty one."""
    return F.when(cell.rlike(r"^[0-9]+\z"), 0).when(cell.rlike(r"^[0-9]+\.[0-9]+\z"), 1).when(cell != "", 2)


def beside(lines: DataFrame, sheets: DataFrame) -> DataFrame:
    """``lines`` joined to one row for each sheet. A sheet's lines are spread over SALTS parts, so that one with a third of all lines isn't a single task's."""
    spread = lines.withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(SALTS)))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    return spread.join(sheets.withColumn("salt", copies), ["sheet_id", "salt"])


INSIDE = "line_no > head_no and (end is null or line_no < end)"


@dataclass
class Sheets:
    lines: DataFrame  # sheet_id, line_no, line: all lines
    columns: DataFrame  # sheet_id, pos (from 0), field, level, long, head_no, end: a row for each header, of equal ones the first

    def rows(self, slots: DataFrame) -> DataFrame:
        """sheet_id, line_no, parts (cells as written), slots of the data rows, a line delivered again once. ``slots``: sheet_id, head_no, end, slots (of any type)."""
        inside = beside(self.lines, slots).filter(INSIDE)
        once = inside.groupBy("sheet_id", "salt", "line_no").agg(F.max("line").alias("line"), F.first("slots").alias("slots"))
        return once.filter(has_content(F.col("line"))).select("sheet_id", "line_no", parts(F.col("line")).alias("parts"), "slots")


def data_sections(lines: DataFrame) -> Sheets:
    """Headers of the first data section of each sheet, with the types of their columns; other sections are left out.

    ``lines``: sheet_id, line_no, line. Order is that of ``line_no``; lines with a null anywhere
    and those without a non-empty cell are ignored. The section ends at the next one or with
    the sheet. Its borders come from the few section lines, by grouped minima, so that no sheet
    has to pass through a single task. Lines delivered twice are no matter for headers, types
    and names; of different texts for one number the smaller is the header.

    ``level`` is a column's place in TYPES, null without values; ``long`` tells of integers of
    more than DIGITS digits. Header and types come from one reading of the lines: of every
    level the last line that shows it is kept for each place, and counts if it lies behind
    the header. What is shuffled for that is one row per sheet and place of a task.
    """
    known = lines.select("sheet_id", "line_no", "line").na.drop()
    first = clean(F.get(parts(F.col("line")), F.lit(0)))
    marks = known.filter(F.col("line").contains("[")).select("sheet_id", "line_no", first.alias("mark")).filter(F.col("mark").startswith("[") & F.col("mark").endswith("]"))
    borders = marks.groupBy("sheet_id").agg(F.min(F.when(F.col("mark").isin(*DATA_SECTIONS), F.col("line_no"))).alias("start"), F.collect_set("line_no").alias("marks"))
    borders = borders.filter("start is not null").select("sheet_id", "start", F.array_min(F.filter("marks", lambda m: m > F.col("start"))).alias("end"))
    inside = beside(known, borders).filter("line_no > start and (end is null or line_no < end)").filter(has_content(F.col("line")))
    heads = inside.groupBy("sheet_id").agg(F.min(F.struct("line_no", "line")).alias("head"), F.max("end").alias("end"))
    heads = heads.select("sheet_id", F.col("head.line_no").alias("head_no"), "end", cells(F.col("head.line")).alias("header"))
    fields = heads.select("sheet_id", "head_no", "end", "header", F.posexplode("header").alias("pos", "field"))
    fields = fields.filter((F.col("field") != "") & (F.array_position("header", F.col("field")) == F.col("pos") + 1)).drop("header")
    seen = inside.select("sheet_id", "line_no", F.posexplode(parts(F.col("line"))).alias("pos", "part")).withColumn("cell", clean(F.col("part")))
    seen = seen.select("sheet_id", "line_no", "pos", level(F.col("cell")).alias("level"), (F.length("cell") > DIGITS).alias("long"))
    last = lambda shown: F.max(F.when(shown, F.col("line_no")))
    shown = seen.groupBy("sheet_id", "pos").agg(*[last(F.col("level") == n).alias(f"l{n}") for n in range(len(TYPES))], last((F.col("level") == 0) & F.col("long")).alias("l"))
    found = F.when(F.lit(False), 0)
    for n in reversed(range(len(TYPES))):
        found = found.when(F.col(f"l{n}") > F.col("head_no"), n)
    both = fields.join(shown, ["sheet_id", "pos"], "left")
    columns = both.select("sheet_id", "pos", "field", found.alias("level"), F.coalesce(F.col("l") > F.col("head_no"), F.lit(False)).alias("long"), "head_no", "end")
    return Sheets(known, checkpointed(columns))


def long_cells(sheets: Sheets) -> DataFrame:
    """``sheet_id``, ``line_no``, ``field``, ``cell``: one row per data row and header; cells that a row lacks are empty."""
    slots = sheets.columns.groupBy("sheet_id", "head_no", "end").agg(F.collect_list(F.struct("field", "pos")).alias("slots"))
    cell = lambda s: F.struct(s["field"].alias("field"), F.coalesce(clean(F.get("parts", s["pos"])), F.lit("")).alias("cell"))
    return sheets.rows(slots).select("sheet_id", "line_no", F.inline(F.transform("slots", cell)))


def neighbours(files: DataFrame) -> DataFrame:
    """``sheet_id``, ``instrument``, ``issued_at``, ``previous``, ``next``, ``next_at``: the sheets of the instrument issued before and after it, null where there is none.

    By windows over an instrument's months; the first and last sheets of the months meet in a
    second window. So the sheets of a busy instrument are spread over its months.
    """
    known = files.select("sheet_id", "instrument", "issued_at").na.drop().dropDuplicates(["sheet_id"]).withColumn("month", F.date_trunc("month", "issued_at"))

    def linked(df: DataFrame, *by) -> DataFrame:
        w = Window.partitionBy("instrument", *by).orderBy("issued_at", "sheet_id")
        new = {"previous": F.lag("sheet_id").over(w), "next": F.lead("sheet_id").over(w), "next_at": F.lead("issued_at").over(w)}
        return df.withColumns({n: F.coalesce(n, c) if n in df.columns else c for n, c in new.items()})

    inner = linked(known, "month").withColumn("part", F.when(F.col("previous").isNotNull() & F.col("next").isNotNull(), F.col("month")))
    return linked(inner, "part").drop("month", "part")


def same_cells(lines: DataFrame, both: DataFrame) -> DataFrame:
    """``target``, ``field``, ``old``: new headers that hold the cells of a gone one (``old``), and such gone ones (``old`` null).

    ``both`` as in ``compared``. Only pairs of sheets with new and gone headers are read. Each
    header's set of distinct (sample, cell) pairs, over the samples of both sheets, is reduced
    to a 128-bit fingerprint, and headers are grouped by it, so that no pairs of headers are
    formed. Cells are hashed when they are read, and a sheet's samples spread over tasks.
    """
    of = lambda side, c: F.max(F.when(F.col(f"pos{side}").isNotNull(), F.col(c)))
    only = lambda side, other: F.collect_list(F.when(F.col(f"pos{side}").isNotNull() & F.col(f"pos{other}").isNull() & (F.col("field") != KEY), F.struct("field", F.col(f"pos{side}").alias("pos"))))
    key = lambda side: F.max(F.when(F.col("field") == KEY, F.col(f"pos{side}")))
    sides = [F.struct(F.lit(s).alias("side"), F.col(i).alias("sheet_id"), *[F.col(f"{c}{s}").alias(c) for c in ("columns", "place", "head_no", "end")]) for s, i in ((1, "target"), (0, "previous"))]
    pairs = both.groupBy("target", "previous").agg(
        only(1, 0).alias("columns1"), only(0, 1).alias("columns0"), key(1).alias("place1"), key(0).alias("place0"), *[of(s, f"{c}{s}").alias(f"{c}{s}") for c in ("head_no", "end") for s in (0, 1)])
    pairs = pairs.filter((F.size("columns1") > 0) & (F.size("columns0") > 0) & F.col("place1").isNotNull() & F.col("place0").isNotNull())
    read = lines.join(pairs.select(F.col("target").alias("pair"), F.inline(F.array(*sides))), "sheet_id").filter(INSIDE)
    read = read.select("pair", "side", "columns", "place", parts(F.col("line")).alias("parts"))
    read = read.select("pair", "side", "columns", "parts", clean(F.get("parts", F.col("place"))).alias("sample")).filter("sample <> ''")
    sampled = read.select("pair", "side", "parts", "sample", F.inline("columns")).select("pair", "side", "sample", "field", F.coalesce(clean(F.get("parts", F.col("pos"))), F.lit("")).alias("cell"))
    cell = F.col("cell")
    distinct = sampled.select("pair", "side", "sample", "field", F.xxhash64(cell).alias("c1"), F.xxhash64(F.lit(1), cell).alias("c2"), (cell != "").alias("full")).distinct()
    sets = distinct.groupBy("pair", "sample", "side", "field").agg(F.bit_xor("c1").alias("c1"), F.bit_xor("c2").alias("c2"), F.count("*").alias("n"), F.max("full").alias("full"))
    shared = sets.groupBy("pair", "sample").agg(F.collect_list(F.struct("side", "field", "c1", "c2", "n", "full")).alias("sets"), F.min("side").alias("low"), F.max("side").alias("high")).filter("low < high")
    prints = shared.select("pair", "sample", F.inline("sets")).groupBy("pair", "side", "field").agg(
        F.bit_xor(F.xxhash64("sample", "c1", "n")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "c2", "sample")).alias("h2"), F.max("full").alias("full")).filter("full")
    named = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("field")))
    alike = prints.groupBy("pair", "h1", "h2").agg(named(1).alias("new"), F.array_sort(named(0)).alias("old")).filter((F.size("new") > 0) & (F.size("old") > 0))
    told = F.concat(
        F.transform("new", lambda f: F.struct(f.alias("field"), F.get("old", F.lit(0)).alias("old"))), F.transform("old", lambda f: F.struct(f.alias("field"), F.lit(None).cast("string").alias("old"))))
    return alike.select(F.col("pair").alias("target"), F.inline(told)).withColumn("matched", F.lit(True))


def compared(sheets: Sheets, order: DataFrame) -> DataFrame:
    """Headers of each sheet (``target``) and of the one before it (``previous``): a row per header, with ``pos1``, ``level1`` here and ``pos0``, ``level0`` there, null where it is missing."""
    ends = [
        F.struct(F.col("sheet_id").alias("target"), "issued_at", "previous", F.lit(1).alias("side")),
        F.struct(F.col("next").alias("target"), F.col("next_at").alias("issued_at"), F.col("sheet_id").alias("previous"), F.lit(0).alias("side")),
    ]
    rows = sheets.columns.join(order, "sheet_id").select("instrument", "field", "pos", "level", "head_no", "end", F.inline(F.array(*ends))).filter("target is not null and previous is not null")
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}")
    return rows.groupBy("target", "instrument", "issued_at", "previous", "field").agg(*[at(c, s) for c in ("pos", "level", "head_no", "end") for s in (0, 1)])


def changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Each change of a sheet's data columns against the sheet issued before it by the instrument.

    ``sheet_id``, ``instrument``, ``issued_at``, ``previous``, ``field``, ``change``
    (``renamed``, ``added``, ``removed``, ``retyped``), ``before`` and ``after`` (the old name
    of a renamed column, of several the first by the alphabet; the types of a retyped one). A
    sheet without data section has no columns; one that ``files`` doesn't name, or whose
    instrument or time is null, isn't compared; empty tables give none; other columns of the
    tables are ignored.
    """
    return reported(data_sections(lines), neighbours(files))


def reported(sheets: Sheets, order: DataFrame) -> DataFrame:
    both = checkpointed(compared(sheets, order))
    found = both.filter(F.col("field") != KEY).join(same_cells(sheets.lines, both), ["target", "field"], "left")
    here, there = F.col("pos1").isNotNull(), F.col("pos0").isNotNull()
    name = lambda n: F.get(F.array(*map(F.lit, TYPES)), F.col(n))
    change = (
        F.when(here & there, F.when(F.col("level1") != F.col("level0"), "retyped"))
        .when(here, F.when(F.col("matched"), "renamed").otherwise("added")).when(F.col("matched").isNull(), "removed")
    )
    before = F.when(F.col("change") == "renamed", F.col("old")).when(F.col("change") == "retyped", name("level0"))
    after = F.when(F.col("change") == "renamed", F.col("field")).when(F.col("change") == "retyped", name("level1"))
    told = found.withColumn("change", change).filter("change is not null")
    return told.select(F.col("target").alias("sheet_id"), "instrument", "issued_at", "previous", "field", "change", before.alias("before"), after.alias("after"))


def classes(names: list[str], links: list[tuple[str, str]], apart: Iterable[Iterable[str]] = ()) -> dict[str, str]:
    """The standing name of each header: linked names, and those equal but for case, share one.

    Names that stand together in one of the sets ``apart`` never come into a class: a link that
    would bring them together is left out. Links are followed in their order.
    """
    parent = {n: n for n in names}
    sets = [[n for n in some if n in parent] for some in apart]

    def root(n: str) -> str:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    by_case: dict[str, str] = {}
    alike = [(by_case.setdefault(n.lower(), n), n) for n in sorted(names)]
    for a, b in [*alike, *links]:
        if a in parent and b in parent and (x := root(a)) != (y := root(b)):
            if not any({x, y} <= {root(n) for n in some} for some in sets):
                parent[y] = x
    groups: dict[str, list[str]] = {}
    for n in sorted(names):
        groups.setdefault(root(n), []).append(n)
    out = {}
    for group in groups.values():
        standing = next((p for p in PREFERRED if p in group), group[0])
        out |= dict.fromkeys(group, standing)
    return out


def standing_names(sheets: Sheets, order: DataFrame, names: list[str], links: list[tuple[str, str]]) -> DataFrame:
    """``sheets.columns`` with ``standing``, the name of the column in the common table; no two headers of a sheet share one.

    All renames together give classes of names. An instrument with a sheet in which two headers
    of a class stand side by side has classes of its own, from the same links without those that
    would merge such headers; a sheet that ``files`` doesn't tell the instrument of counts as an
    instrument. Sent to an instrument's task are its distinct sets of such headers, at most as
    many as there are sets among the names.
    """
    spark = sheets.columns.sparkSession
    common = classes(names, links)
    known = spark.createDataFrame(sorted(common.items()), "field string, common string")
    whose = order.select("sheet_id", F.concat(F.lit("i"), "instrument").alias("owner"))
    named = sheets.columns.join(F.broadcast(known), "field").join(whose, "sheet_id", "left")
    named = checkpointed(named.withColumn("owner", F.coalesce("owner", F.concat(F.lit("s"), F.col("sheet_id").cast("string")))))
    sets = named.groupBy("owner", "sheet_id", "common").agg(F.array_sort(F.collect_set("field")).alias("together")).filter(F.size("together") > 1)
    members: dict[str, list[str]] = {}
    for n, s in common.items():
        members.setdefault(s, []).append(n)

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        some = [n for s in frame["common"].unique() for n in members[s]]
        found = classes(some, links, [list(x) for x in frame["together"]])
        return pd.DataFrame({"owner": frame["owner"].iloc[0], "field": list(found), "own": list(found.values())})

    split = sets.select("owner", "common", "together").distinct().groupBy("owner").applyInPandas(own, "owner string, field string, own string")
    return named.join(split, ["owner", "field"], "left").withColumn("standing", F.coalesce("own", "common")).drop("own", "common", "owner")


def sample_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All sample rows in one table: ``sheet_id``, ``line_no`` and the union of the columns.

    Renamed headers (and those that differ in case only) share a column, but where an
    instrument has a sheet with both of them: there each keeps its own (see
    ``standing_names``), and no cell of a header is lost. A column's type is the widest that
    any sheet has for it - ``bigint`` for integers, ``double`` for decimals, ``string`` for text
    and where an integer has more than 18 digits - and empty cells are null. Sheets that lack a column have null there. Of
    equal headers of a sheet the first counts. Repeated rows of a sheet stay. Names equal but
    for case, or equal to ``sheet_id`` and ``line_no``, get trailing underscores. At most
    MOST_HEADERS different headers; above that ValueError, and ``long_cells`` gives the same
    in long form for any number.
    """
    sheets, order = data_sections(lines), checkpointed(neighbours(files))
    names = [r[0] for r in sheets.columns.select("field").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(names) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers; use long_cells")
    renamed = reported(sheets, order).filter("change = 'renamed'").groupBy("before", "after").count().collect()
    links = [(a, b) for a, b, _ in sorted(map(tuple, renamed), key=lambda r: (-r[2], r))]
    named = checkpointed(standing_names(sheets, order, names, links))
    kinds = named.groupBy("standing").agg(F.max("level").alias("level"), F.max("long").alias("long")).collect()
    place = lambda n: (PREFERRED.index(n) if n in PREFERRED else len(PREFERRED), n)
    out, taken = [], {"sheet_id", "line_no"}
    for r in sorted(kinds, key=lambda r: place(r["standing"])):
        kind = "string" if r["long"] else {0: "bigint", 1: "double"}.get(r["level"], "string")
        alias = r["standing"]
        while alias.lower() in taken:
            alias += "_"
        taken.add(alias.lower())
        out.append(F.nullif(clean(F.get("parts", F.try_element_at("slots", F.lit(r["standing"])))), F.lit("")).cast(kind).alias(alias))
    slots = named.groupBy("sheet_id", "head_no", "end").agg(F.map_from_entries(F.collect_list(F.struct("standing", "pos"))).alias("slots"))
    return sheets.rows(slots).select("sheet_id", "line_no", *out)
