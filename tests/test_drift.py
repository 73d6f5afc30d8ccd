"""Schema drift against a plain reading of the definition, sheet by sheet."""

import csv
import datetime as dt
import random
import re

import pytest

from lanewise.operators import drift


def plain_sheet(lines):
    """Header and rows of the first data section, read with the csv module."""
    header, rows, inside, seen = None, [], False, False
    for _, line in sorted(set(lines)):
        line = line.lstrip("﻿")
        cells = [c.strip().strip('"').strip() for c in next(csv.reader([line], skipinitialspace=True), [])]
        if not any(cells):
            continue
        if cells[0].startswith("[") and cells[0].endswith("]"):
            inside = cells[0] in ("[Data]", "[BCLConvert_Data]") and not seen
            seen = seen or inside
        elif inside and header is None:
            header = cells
        elif inside:
            rows.append(cells + [""] * len(header))
    return header or [], rows


def kind(values):
    full = [v for v in values if v]
    if not full:
        return None
    if all(re.fullmatch("[0-9]+", v) for v in full):
        return "integer"
    return "decimal" if all(re.fullmatch(r"[0-9]+(\.[0-9]+)?", v) for v in full) else "text"


def plain_changes(lines, files):
    sheets = {}
    for sheet, n, line in lines:
        sheets.setdefault(sheet, []).append((n, line))
    read = {s: plain_sheet(x) for s, x in sheets.items()}
    out = set()
    by = {}
    for sheet, instrument, at in files:
        by.setdefault(instrument, []).append((at, sheet))
    for some in by.values():
        ordered = [s for _, s in sorted(some)]
        for before, now in zip(ordered, ordered[1:]):
            (h0, r0), (h1, r1) = read.get(before, ([], [])), read.get(now, ([], []))
            col = lambda h, r, f: [x[h.index(f)] for x in r]
            new, gone = [f for f in dict.fromkeys(h1) if f and f not in h0], [f for f in dict.fromkeys(h0) if f and f not in h1]
            matched = set()
            for f in new:
                held = []
                for g in gone:
                    a, b = {}, {}
                    for s, v in zip(col(h1, r1, "Sample_ID"), col(h1, r1, f)) if "Sample_ID" in h1 else ():
                        a.setdefault(s, set()).add(v)
                    for s, v in zip(col(h0, r0, "Sample_ID"), col(h0, r0, g)) if "Sample_ID" in h0 else ():
                        b.setdefault(s, set()).add(v)
                    both = (set(a) & set(b)) - {""}
                    if both and all(a[s] == b[s] for s in both) and any(a[s] != {""} for s in both):
                        held.append(g)
                matched |= set(held)
                if f != "Sample_ID":
                    out.add((now, f, "renamed" if held else "added"))
            out |= {(now, g, "removed") for g in gone if g not in matched and g != "Sample_ID"}
            for f in set(h0) & set(h1) - {"", "Sample_ID"}:
                k0, k1 = kind(col(h0, r0, f)), kind(col(h1, r1, f))
                if k0 and k1 and k0 != k1:
                    out.add((now, f, "retyped"))
    return out


def run(spark, lines, files):
    a = spark.createDataFrame(lines, "sheet_id long, line_no int, line string")
    b = spark.createDataFrame([(s, i, t) for s, i, t in files], "sheet_id long, instrument string, issued_at timestamp")
    found = [tuple(r) for r in drift.changes(a, b).select("sheet_id", "field", "change").collect()]
    assert len(found) == len(set(found))
    return set(found)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_random_sheets_agree_with_the_definition(spark):
    rng = random.Random(3)
    lines, files = [], []
    for sheet in range(40):
        names = ["Lane", "Sample_ID", "index", rng.choice(["index2", "i5"]), *rng.sample(["Sample_Project", "Note", "sample_project", "Weight"], rng.randint(0, 3))]
        rng.shuffle(names)
        quote = (lambda c: f'"{c}"') if rng.random() < 0.3 else (lambda c: f" {c} " if rng.random() < 0.1 else c)
        text = ["﻿[Header]" if sheet % 5 == 0 else "[Header],,", "", "[Reads]", "151", rng.choice(["[Data]", "[BCLConvert_Data],,"]), ",,", ",".join(map(quote, names)) + ",,"]
        project = rng.random() < 0.5
        for s in rng.sample(range(6), rng.randint(0, 5)):
            value = {"Lane": str(s % 3) if sheet % 3 else f"lane {s}", "Sample_ID": f"S{s}", "index": "ACGT"[s % 4] * 4, "index2": f"T{s}", "i5": f"T{s}", "Weight": rng.choice(["1", "2.5", ""]), "Note": ""}
            text.append(",".join(quote(value.get(n, f"P, {s}".replace(",", "") if project else str(s))) for n in names))
        text += ["[Settings]", "a,b"]
        lines += [(sheet, n, t) for n, t in enumerate(text)] + [(sheet, 2, text[2])]
        files.append((sheet, f"M{sheet % 3}", day(sheet * 11 % 97)))
    rng.shuffle(lines)
    assert run(spark, lines, files) == plain_changes(lines, files)


def test_nulls_sheets_without_section_and_empty_tables(spark):
    lines = [(1, 1, "[Data]"), (1, 2, "Sample_ID,Lane"), (1, 3, "a,1"), (1, None, "x"), (None, 1, "x"), (1, 4, None), (2, 1, "[Header]"), (2, 2, "x")]
    files = [(1, "M", day(1)), (2, "M", day(2)), (3, "M", day(40)), (4, None, day(3)), (5, "M", None)]
    assert run(spark, lines, files) == {(2, "Lane", "removed")}
    assert run(spark, [], []) == set()
    assert run(spark, lines, []) == set()


def test_repeated_headers_and_clashing_names(spark):
    lines = [(1, 1, "[Data]"), (1, 2, "Sample_ID,sheet_id,Lane,Lane"), (1, 3, "a,7,1,x"), (2, 1, "[Data]"), (2, 2, "Sample_ID,sheet_id,lane"), (2, 3, "a,8,2"), (2, 3, "a,8,2")]
    a = spark.createDataFrame(lines, "sheet_id long, line_no int, line string")
    b = spark.createDataFrame([(1, "M", day(1)), (2, "M", day(2))], "sheet_id long, instrument string, issued_at timestamp")
    rows = drift.sample_rows(a, b)
    assert rows.dtypes == [("sheet_id", "bigint"), ("line_no", "int"), ("Lane", "bigint"), ("Sample_ID", "string"), ("sheet_id_", "bigint")]
    assert sorted(map(tuple, rows.collect())) == [(1, 3, 1, "a", 7), (2, 3, 2, "a", 8)]


def test_rows_of_renamed_columns_meet(spark):
    lines = [(1, 1, "[Data]"), (1, 2, "Sample_ID,index2,W"), (1, 3, "a,T,1"), (2, 1, "[Data]"), (2, 2, "Sample_ID,i5,W"), (2, 3, "a,T,2.5"), (2, 4, "b,,")]
    a = spark.createDataFrame(lines, "sheet_id long, line_no int, line string")
    b = spark.createDataFrame([(1, "M", day(1)), (2, "M", day(70))], "sheet_id long, instrument string, issued_at timestamp")
    rows = drift.sample_rows(a, b)
    assert sorted(map(tuple, rows.select("sheet_id", "Sample_ID", "index2", "W").collect())) == [(1, "a", "T", 1.0), (2, "a", "T", 2.5), (2, "b", None, None)]


@pytest.mark.parametrize(("names", "links", "want"), [(["a", "B", "b"], [], {"a": "a", "B": "B", "b": "B"}), (["x", "index2"], [("x", "index2")], {"x": "index2", "index2": "index2"})])
def test_standing_names(names, links, want):
    assert drift.classes(names, links) == want


def test_headers_side_by_side_keep_their_cells(spark):
    lines = [(1, 1, "[Data]"), (1, 2, "Sample_ID,X"), (1, 3, "a,T"), (2, 1, "[Data]"), (2, 2, "Sample_ID,Y"), (2, 3, "a,T"),
             (3, 1, "[Data]"), (3, 2, "Sample_ID,X,Y"), (3, 3, "s9,left,right"), (4, 1, "[Data]"), (4, 2, "note,Sample_ID,Note"), (4, 3, "1,b,z"), (5, 1, "[Data]"), (5, 2, "Y,NOTE"), (5, 3, "u,v")]
    a = spark.createDataFrame(lines, "sheet_id long, line_no int, line string")
    b = spark.createDataFrame([(1, "M", day(1)), (2, "M", day(2)), (3, "N", day(3)), (5, "P", day(3))], "sheet_id long, instrument string, issued_at timestamp")
    rows = drift.sample_rows(a, b)
    assert sorted(c.lower() for c in rows.columns) == ["line_no", "note", "note_", "sample_id", "sheet_id", "x", "y"]
    got = {r["sheet_id"]: r for r in rows.collect()}
    assert (got[1]["X"], got[2]["X"], got[2]["Y"]) == ("T", "T", None)  # renamed at this instrument
    assert (got[3]["X"], got[3]["Y"]) == ("left", "right")
    assert sorted(str(v) for v in tuple(got[4])[2:] if v is not None) == ["1", "b", "z"]
    assert got[5]["X"] == "u" and got[5]["Y"] is None and "v" in tuple(got[5])
    cells = drift.long_cells(drift.data_sections(a)).filter("cell <> ''").count()
    assert cells == sum(v is not None for r in got.values() for v in tuple(r)[2:])


def test_classes_keep_apart_what_stands_together():
    names, links = ["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "d")]
    assert drift.classes(names, links, [["a", "c"]]) == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert drift.classes(["n", "N"], [], [["n", "N"]]) == {"n": "n", "N": "N"}
