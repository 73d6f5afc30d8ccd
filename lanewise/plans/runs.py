"""Whole tools over files: from a folder of reads and a sheet to the reports or files of a run."""

from __future__ import annotations

import csv
import datetime as dt
import json
import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import masks, names
from lanewise.operators import mixing, ncontent, rewind, search, sheets, synth
from lanewise.runtime import checkpointed
from lanewise.sources import files

UNDETERMINED = "Undetermined*R1*.fastq.gz"
MIXING_COLUMNS = ["Lane", "Undetermined_Index", "Count", "Fraction", "Sample_Project", "Lane_Project", "index1", "index2"]


def write_csv(rows: DataFrame, path: str) -> int:
    """One file with a header, row by row through the driver; the number of rows."""
    n = 0
    with files.create(path) as out:
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        for n, row in enumerate(rows.toLocalIterator(), start=1):
            writer.writerow(["" if v is None else v for v in row])
    return n


def mixing_report(spark: SparkSession, folder: str, sheet_text: str) -> tuple[DataFrame, DataFrame]:
    """Unexpected indexes of a flowcell's undetermined reads, ordered, and their sums by lane."""
    reads = files.read_sequences(spark, folder, UNDETERMINED)
    sheet = sheets.mixing_sheet(sheets.read_sheet(spark, sheet_text))
    hits = mixing.unexpected(mixing.index_mixing(sheet, mixing.top_barcodes(mixing.undetermined(reads))), sheet)
    ordered = hits.select(MIXING_COLUMNS).orderBy("Lane", F.col("Count").desc(), *[c for c in MIXING_COLUMNS if c not in ("Lane", "Count")])
    return ordered, mixing.by_lane(hits).orderBy("Lane")


def n_report(spark: SparkSession, paths: list[str], output: str) -> None:
    """Per input: rows and chart of reads by their number of N, and of N by cycle and tile."""
    files.make_folder(output)
    for path in paths:
        positions = ncontent.n_positions(files.read_sequences(spark, path))
        stem = path.rpartition("/")[2].removesuffix(".gz").rpartition(".")[0]
        for what, rows, form in (
            ("n_counts", ncontent.n_count_histogram(positions).orderBy("n_count"), {"mark": "bar", "x": "n_count", "y": "n_sequences", "log": True}),
            ("n_per_cycle", ncontent.n_by_cycle_filled(positions).orderBy("tile", "cycle"), {"mark": "line", "x": "cycle", "y": "n_count", "color": "tile"}),
        ):
            data = [r.asDict() for r in rows.drop("file").collect()]
            if not data:
                logging.warning("no N, or read names without coordinates, in %s", path)
            files.write_text(f"{output}/{stem}_{what}.json", json.dumps(ncontent.chart(data, **form)))
            files.write_text(f"{output}/{stem}_{what}.svg", ncontent.drawing(data, **form))


def search_report(spark: SparkSession, path: str, patterns: list[str], errors: int, kind: str) -> tuple[dict[int, list[str]], dict[int, list[str]]]:
    """Lines of matches and of errors for each pattern that matches anything; one pass over the reads."""
    counts, total = search.tally(files.read_sequences(spark, path), patterns, errors, kind)
    lines: tuple[dict, dict] = ({}, {})
    for rows, into in ((search.match_report(counts), lines[0]), (search.error_report(search.error_totals(counts, len(patterns), errors, total)), lines[1])):
        for r in rows.orderBy("pattern_no", "line_no").collect():
            into.setdefault(r["pattern_no"], []).append(r["line"])
    for n, p in enumerate(patterns, start=1):
        if n not in lines[0]:
            logging.warning("no match of %s", p)
            lines[1].pop(n, None)
    return lines


def clusters(spark: SparkSession, folder: str, recipes: DataFrame, single_umi_first: bool = True) -> DataFrame:
    """All reads of a demultiplexed folder as clusters: lane, tile, x, y, pos, sequence, quality. Index files and undetermined reads are left out.

    Files are read once. Samples with a second file are merged from both, others from the first;
    a pair that lacks its second read, though the sample's mask has one, raises.
    """
    base = F.element_at(F.split("file", "/"), -1)
    reads = files.read_sequences(spark, folder, "*.fastq.gz").withColumn("base", base).filter(F.col("base").rlike("_R[12]_"))
    mates = reads.select(
        F.regexp_extract(names.lane_part(F.col("base")), "[1-9]", 0).cast("bigint").alias("lane"), names.sample_of_file(F.col("base")).alias("sample"),
        "pos", F.regexp_extract("base", "_R([12])_", 1).cast("int").alias("mate"), "name", "sequence", "quality")
    known = rewind.with_recipe(mates, recipes.select("sample", (F.col("R2") == 0).alias("alone")))
    merged = rewind.merge_paired(rewind.with_recipe(rewind.pair(known, "alone"), recipes), single_umi_first)
    return rewind.located(merged).select("lane", "tile", "x", "y", F.concat_ws("/", "sample", F.format_string("%015d", "pos")).alias("pos"), "sequence", "quality")


def rewind_run(spark: SparkSession, folder: str, output: str, sheet_text: str, total_cycles: int | None = None, single_umi_first: bool = True, day: dt.datetime | None = None, controls: bool = False) -> int:
    """The instrument's folder of a run out of its demultiplexed reads; the number of cycles.

    Reads are paired and merged once, into the shared folder; all files come out of that, in
    parts. Folders may lie in any file system that pyarrow knows.
    """
    sheet = sheets.read_sheet(spark, sheet_text, required=("Lane", "Sample_Name", "index", "index2", "OverrideCycles"))
    recipes = sheets.masks_table(sheet)
    cycles = sheets.read_cycles(sheet_text)
    total = max(sum(cycles.values()), total_cycles or 0)
    merged = checkpointed(clusters(spark, folder, recipes, single_umi_first))
    held = merged.select("lane", "tile").distinct().collect()  # bounded by the geometry
    lanes = sorted({r["lane"] for r in held})
    if not lanes:
        raise ValueError(f"no reads of the sheet's samples in {folder}")
    files.write_blobs(rewind.cycle_files(rewind.cycle_blocks(merged, total)), output)
    places = checkpointed(rewind.occupied(merged))
    files.write_blobs(rewind.position_file(places.select("x", "y")), output)
    # every tile of a lane has a filter file, those without reads too
    every = [r["tile"] for r in synth.all_tiles(spark).collect()]
    files.write_blobs(rewind.filter_files(places, lanes, every, controls), output)
    begin = next(f for f in files.listed(folder, "*.fastq.gz") if "Undetermined" not in f.rpartition("/")[2])
    name = next(iter(files.fastq_records(begin)), ("",))[0]
    first = spark.range(1).select(names.read_name_fields(F.lit(name)).alias("f")).first()["f"]
    day = day or dt.datetime.now(dt.timezone.utc)
    run = f"{day:%y%m%d}{first['instrument']}_{first['run_number']:04d}_{first['flowcell_id']}"
    shown = [{"number": i, "key": k, "cycles": n, "is_index": "N" if k[0] == "R" else "Y"} for i, (k, n) in enumerate(((k, n) for k, n in cycles.items() if n), start=1)]
    tiles = [f"{lane}_{tile}" for lane, tile in sorted((r["lane"], r["tile"]) for r in held)]
    files.write_text(f"{output}/RunInfo.xml", rewind.run_info_xml(run, first["run_number"], first["flowcell_id"], first["instrument"], f"{day:%Y-%m-%dT%H:%M:%SZ}", shown, len(lanes), tiles))
    copy = f"{output}/SampleSheet.csv"
    if files.exists(copy):
        logging.warning("%s is there already and isn't replaced", copy)
    else:
        files.write_text(copy, sheet_text)
    return total


def generate_run(spark: SparkSession, output: str, sheet_text: str, number: int, alphabet: str, extended: bool, flowcell: str | None, seed: int, day: dt.date | None = None, taint: bool = False) -> str:
    """A demultiplexed flowcell folder with ``number`` reads of each sample of the sheet; its path.

    With ``taint`` about a tenth of each sample's reads also lie in its lane's undetermined file.
    """
    sheet, named = sheets.generator_sheet(spark, sheet_text)
    cell = named or synth.flowcell_id(seed)
    instrument, run = f"VH{10000 + seed % 90000}", 100 + seed % 900
    top = f"{output}/{flowcell or f'{day or dt.date.today():%Y%m%d}_{instrument}_{run:04d}_A{cell}'}"
    files.make_folder(top)
    files.write_text(f"{top}/SampleSheet.csv", sheet_text)
    found = sheets.sample_numbers(sheet).withColumn("m", masks.parse_mask(F.col("OverrideCycles"))).orderBy("number").collect()
    placed = synth.sample_tiles(spark.createDataFrame([(i, r["number"]) for i, r in enumerate(found)], "n long, number int"))
    tile_of = {r["n"]: r["tile"] for r in placed.join(synth.all_tiles(spark), F.col("tile_no") == F.col("no")).collect()}
    if len(tile_of) < len(found):
        raise ValueError("more samples than tiles of a lane")
    rows = []
    for i, r in enumerate(found):
        m = r["m"]
        if m["I1"] and len(r["index"] or "") != m["I1"] or m["I2"] and len(r["index2"] or "") != m["I2"]:
            raise ValueError(f"the indexes of {r['Sample_ID']} don't have the length of its mask")
        rows.append((i, f"{instrument}:{run}:{cell}:{r['Lane']}", tile_of[i], r["Sample_Project"], r["Sample_ID"], r["Lane"], r["number"], m["R1"], m["R2"], m["U1"], m["U2"], r["index"] if m["I1"] else "", r["index2"] if m["I2"] else ""))
    table = spark.createDataFrame(rows, "n int, prefix string, tile long, Sample_Project string, Sample_ID string, Lane string, number int, R1 int, R2 int, U1 int, U2 int, i1 string, i2 string")
    ready = table.withColumn("extension", names.read_extension(F.col("i1"), F.col("i2"), extended)).withColumn("reads", 1 + (F.col("R2") > 0).cast("int"))
    paths = synth.sample_paths(ready).join(ready.select("n", "number"), "number")
    reads = synth.sample_reads(ready, number, alphabet, seed).join(F.broadcast(paths.select("n", "mate", F.col("path").alias("file"))), ["n", "mate"])
    if taint:
        lane = names.lane_name(F.split_part("name", F.lit(":"), F.lit(4)))
        some = reads.filter(F.pmod(F.xxhash64(F.lit(seed), "n", "pos"), F.lit(10)) == 0)
        other = F.concat(F.lit("Demultiplexing/Undetermined_S0_"), lane, F.lit("_R"), F.col("mate").cast("string"), F.lit("_001.fastq.gz"))
        reads = reads.unionByName(some.withColumns({"file": other, "pos": F.col("n") * F.lit(number).cast("bigint") + F.col("pos")}))
    files.write_sequences(reads, top)
    return top


def sequence_lines(rows: Iterable, kind: str, prefix: str, extension: str, seed: int) -> Iterable[str]:
    """Text of generated sequences in the form that is asked for."""
    import random

    rng = random.Random(seed)
    for n, s in enumerate(rows, start=1):
        if kind == "fasta":
            yield f">seq{n}\n{s}"
        elif kind == "text":
            yield s
        else:
            yield f"@{prefix}:{rng.randrange(10000)}:{rng.randrange(10000)}:{rng.randrange(10000)}{extension}\n{s}\n+\n{'I' * len(s)}"


def expand_patterns(pattern: str | None, path: str | None, spark: SparkSession) -> list[str]:
    from lanewise.sources.text import read_patterns

    return [pattern] if pattern else read_patterns(spark, path)

