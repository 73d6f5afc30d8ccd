"""From demultiplexed reads back to what the instrument wrote: one cluster per row, then bytes per cycle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import encode, names
from lanewise.runtime import checkpointed
from lanewise.schema import BLOCK, ORIGIN, PARTS, SHIFT

SYNTHETIC = "I"
VALID_TILE = "^[12][1-4][01][0-9]$"
#: Height of the stripes into which tiles and positions are split, and rows that a task packs at once (even).
STRIPE, RANGE = 256, 16_384
CALLS = "Data/Intensities/BaseCalls"


def organise(files: DataFrame) -> DataFrame:
    """``lane``, ``sample``, ``files``: FASTQ files of each sample, sorted; a name without lane raises."""
    lane = names.lane_part(F.col("file"))
    known = F.when(lane.isNotNull(), lane).otherwise(F.raise_error(F.concat(F.lit("no lane in "), F.col("file"))))
    return files.groupBy(known.alias("lane"), names.sample_of_file(F.col("file")).alias("sample")).agg(F.array_sort(F.collect_list("file")).alias("files"))


def pair(mates: DataFrame, alone: str | None = None) -> DataFrame:
    """Reads of a pair side by side: lane, sample, pos, name, sequence1, quality1, sequence2, quality2.

    One aggregation by (lane, sample, pos), without a map-side step, as mates lie in different
    files; a mate that is missing, there twice or of another name raises. ``alone`` names a
    boolean column, the same for a whole sample: where it is true, a first mate may be without
    second, whose sequence and quality are null then.
    """
    core = F.split_part("name", F.lit(" "), F.lit(1))
    one = lambda m, c: F.max(F.when(F.col("mate") == m, F.col(c)))
    both = mates.repartition("lane", "sample", "pos").groupBy("lane", "sample", "pos").agg(
        F.count("*").alias("n"), F.min(core).alias("a"), F.max(core).alias("b"), F.max(F.col(alone) if alone else F.lit(False)).alias("alone"), one(1, "name").alias("name"),
        one(1, "sequence").alias("sequence1"), one(1, "quality").alias("quality1"), one(2, "sequence").alias("sequence2"), one(2, "quality").alias("quality2"))
    two = (F.col("n") == 2) & (F.col("a") == F.col("b")) & F.col("sequence2").isNotNull()
    good = F.col("sequence1").isNotNull() & (two | (F.col("n") == 1) & F.col("alone"))
    return both.withColumn("name", F.when(good, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("mates don't fit at "), F.col("a"))))).drop("n", "a", "b", "alone")


def with_recipe(reads: DataFrame, recipes: DataFrame) -> DataFrame:
    """Reads with their sample's mask. A sheet has few rows; whether its side is broadcast is left to the measured sizes."""
    return reads.join(recipes, "sample")


def umis(name: Column) -> tuple[Column, Column]:
    part = F.nullif(F.regexp_extract(name, r"^(?:[^: ]+:){7}([A-Z]+(?:\+[A-Z]+)?)", 1), F.lit(""))
    first, second = F.split_part(part, F.lit("+"), F.lit(1)), F.nullif(F.split_part(part, F.lit("+"), F.lit(2)), F.lit(""))
    return first, second


def marks(text: Column) -> Column:
    return F.repeat(F.lit(SYNTHETIC), F.length(text))


def merge_single(reads: DataFrame) -> DataFrame:
    """Single-end reads with their index appended."""
    return reads.select("sample", "lane", "pos", "name", F.concat("sequence", "I1").alias("sequence"), F.concat("quality", marks(F.col("I1"))).alias("quality"))


def merge_paired(pairs: DataFrame, single_umi_first: bool = True) -> DataFrame:
    """All cycles of a cluster in order: padding, umi, read 1, padding, indexes, padding, umi, read 2, padding; of one without second read as ``merge_single``.

    A single umi belongs to read 1 if the mask has it there (``single_umi_first``), or always
    before read 2. What isn't measured gets the highest quality.
    """
    first, second = umis(F.col("name"))
    if single_umi_first:
        u1, u2 = first, second
    else:
        u1, u2 = F.when(second.isNotNull(), first), F.coalesce(second, first)
    u1, u2 = (F.coalesce(u, F.lit("")) for u in (u1, u2))
    parts = [F.col("R1B"), u1, (F.col("sequence1"), F.col("quality1")), F.col("R1A"), F.col("I1"), F.col("I2"), F.col("R2B"), u2, (F.col("sequence2"), F.col("quality2")), F.col("R2A")]
    text = F.concat(*[p[0] if isinstance(p, tuple) else p for p in parts])
    quality = F.concat(*[p[1] if isinstance(p, tuple) else marks(p) for p in parts])
    single = F.col("sequence2").isNull()
    return pairs.select(
        "sample", "lane", "pos", "name", F.when(single, F.concat("sequence1", "I1")).otherwise(text).alias("sequence"),
        F.when(single, F.concat("quality1", marks(F.col("I1")))).otherwise(quality).alias("quality"))


def located(reads: DataFrame) -> DataFrame:
    """Reads with tile, x and y from their names; unknown forms raise."""
    at = names.read_name_fields(F.col("name"), only=("tile", "x", "y"))
    return reads.withColumn("at", at).select(*reads.columns, "at.tile", "at.x", "at.y")


def valid_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.filter(F.col("tile").cast("string").rlike(VALID_TILE))


def tile_positions(clusters: DataFrame) -> DataFrame:
    return clusters.select("lane", "tile", "x", "y").distinct()


def unique_positions(clusters: DataFrame) -> DataFrame:
    """Every position of the run once: ``x`` and ``y`` shifted as the files hold them."""
    return clusters.select((F.col("x") + SHIFT).alias("x"), (F.col("y") + SHIFT).alias("y")).distinct()


def filters(clusters: DataFrame, tiles: DataFrame) -> DataFrame:
    """For each of ``tiles`` (lane, tile) and each position of the run, whether the tile has a cluster there.

    The output is by its nature the product of both, since each tile's file covers all
    positions: each position carries the list of its tiles, whose number is bounded by the
    geometry, so no pairs are compared and nothing is joined.
    """
    wanted = tiles.select("lane", "tile").distinct().collect()
    has = clusters.groupBy("x", "y").agg(F.collect_set(F.struct(F.col("lane").cast("bigint").alias("lane"), F.col("tile").cast("bigint").alias("tile"))).alias("has"))
    every = F.array(*[F.struct(F.lit(l).cast("bigint").alias("lane"), F.lit(t).cast("bigint").alias("tile")) for l, t in wanted])
    return has.select((F.col("x") + SHIFT).alias("x"), (F.col("y") + SHIFT).alias("y"), "has", F.explode(every).alias("t")).select(
        "t.lane", "t.tile", "x", "y", F.array_contains("has", F.col("t")).cast("int").alias("passed"))


def layout(tiles: DataFrame) -> DataFrame:
    """Numbers of lanes, surfaces, swaths and (lane, tile) pairs of ``tiles`` (lane, tile)."""
    t = F.col("tile").cast("string")
    return tiles.distinct().agg(
        F.countDistinct("lane").alias("lanes"), F.countDistinct(F.substring(t, 1, 1)).alias("surfaces"),
        F.countDistinct(F.substring(t, 2, 1)).alias("swaths"), F.count("*").alias("tiles"))


def tile_names(tiles: DataFrame) -> DataFrame:
    """``1_1101`` and so on, by lane and tile."""
    return tiles.distinct().orderBy("lane", "tile").select(F.concat_ws("_", F.col("lane").cast("string"), F.col("tile").cast("string")).alias("name"))


def cycle_hex(clusters: DataFrame, cycles: int) -> DataFrame:
    """``lane``, ``tile``, ``cycle``, ``clusters``, ``hex``: the packed calls as hexadecimal text.

    The plain form of ``cycle_blocks`` out of built-in functions, with a row for each call; it
    serves to check the packed one.
    """
    base = F.explode(F.sequence(F.lit(1), F.lit(cycles))).alias("cycle")
    calls = clusters.select("lane", "tile", F.struct("y", "x", "pos").alias("ord"), "sequence", "quality", base)
    code = F.when(F.col("cycle") <= F.length("sequence"), encode.nibble(F.expr("substring(sequence, cycle, 1)"), F.expr("substring(quality, cycle, 1)"))).otherwise(0)
    rows = calls.select("lane", "tile", "cycle", F.struct("ord", F.lower(F.hex(code)).alias("digit")).alias("d"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["digit"]), "")
    packed = rows.groupBy("lane", "tile", "cycle").agg(F.count("*").alias("clusters"), text.alias("hex"))
    return packed.withColumn("hex", F.when(F.col("clusters") % 2 == 1, F.concat("hex", F.lit("0"))).otherwise(F.col("hex")))


def ranges(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of at most RANGE rows, each of one value of the first ``keys`` columns; constant memory."""
    held, size, now = [], 0, None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            key = [batch.column(i)[at].as_py() for i in range(keys)]
            if size and (key != now or size == RANGE):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            now = key
            same = np.ones(batch.num_rows - at, bool)
            for i, k in enumerate(key):
                same &= batch.column(i).to_numpy(zero_copy_only=False)[at:] == k
            end = len(same) if same.all() else int(np.argmin(same))
            n = min(end, RANGE - size)
            held.append(batch.slice(at, n))
            size, at = size + n, at + n
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def cycle_blocks(clusters: DataFrame, cycles: int) -> DataFrame:
    """Packed and compressed calls by (lane, surface, tile, cycle), clusters ordered by (y, x, pos).

    Reads become cycles by transposed byte matrices, in place of a row per call. Tiles are split
    into stripes of STRIPE coordinates, sorted by Spark, and packed in ranges of RANGE clusters;
    then the ranges of a tile and cycle, half a byte for each cluster, are put together in their
    order. So neither a tile's reads nor its cycles come together in a task. A read longer than
    ``cycles`` raises, a shorter one is filled up with 0.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(ranges(batches, 3)):
            lane, tile, stripe = (rows.column(i)[0].as_py() for i in range(3))
            plain = encode.packed(encode.call_codes(rows.column("sequence").chunk(0), rows.column("quality").chunk(0), cycles))
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * cycles, t) for v, t in ((lane, pa.int64()), (tile, pa.int64()), (stripe, pa.int64()), (n, pa.int64()), (rows.num_rows, pa.int64()))]
                + [pa.array(range(1, cycles + 1), pa.int32()), pa.array([row.tobytes() for row in plain], pa.binary())], names=["lane", "tile", "stripe", "n", "clusters", "cycle", "calls"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lane, tile, cycle, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                codes = [encode.unpacked(x["calls"], x["clusters"]) for x in parts]
                raw = encode.packed(np.concatenate(codes)).tobytes()
                block = encode.compress(raw)
                rows.append((lane, tile // 1000, tile, cycle, sum(map(len, codes)), len(raw), len(block), block))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=BLOCK.names)

    keyed = clusters.select(
        F.col("lane").cast("bigint").alias("lane"), F.col("tile").cast("bigint").alias("tile"), F.floor(F.col("y") / STRIPE).alias("stripe"), "y", "x", "pos",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("sequence", "quality")])
    striped = keyed.repartition("lane", "tile", "stripe").sortWithinPartitions("lane", "tile", "stripe", "y", "x", "pos").select("lane", "tile", "stripe", "sequence", "quality")
    parts = striped.mapInArrow(pack, "lane long, tile long, stripe long, n long, clusters long, cycle int, calls binary")
    whole = parts.groupBy("lane", "tile", "cycle").agg(F.array_sort(F.collect_list(F.struct("stripe", "n", "clusters", "calls"))).alias("parts"))
    return whole.mapInArrow(join, BLOCK)


def tile_metrics(blocks: DataFrame) -> DataFrame:
    return blocks.select("lane", "surface", "tile", "cycle", "clusters", "usize", "csize")


def cycle_files(blocks: DataFrame) -> DataFrame:
    """``path``, ``ord``, ``content``: the file of each lane, surface and cycle in parts, a header and then the blocks of its tiles in order.

    ``blocks`` are used twice, so they are written to the shared folder; what comes together
    for a header are the numbers of at most as many tiles as the geometry has.
    """
    blocks = checkpointed(blocks)
    name = F.concat(F.lit(f"{CALLS}/L00"), "lane", F.lit("/C"), "cycle", F.lit(".1/L00"), "lane", F.lit("_"), "surface", F.lit(".cbcl"))

    @F.pandas_udf("binary")
    def header(tiles: pd.Series) -> pd.Series:
        return tiles.map(lambda some: encode.cbcl_header([(t["tile"], t["clusters"], t["usize"], t["csize"]) for t in some]))

    tiles = blocks.groupBy("lane", "surface", "cycle").agg(F.array_sort(F.collect_list(F.struct("tile", "clusters", "usize", "csize"))).alias("tiles"))
    heads = tiles.select(name.alias("path"), F.lit(-1).cast("bigint").alias("ord"), header("tiles").alias("content"))
    return heads.unionByName(blocks.select(name.alias("path"), F.col("tile").alias("ord"), F.col("block").alias("content")))


def in_stripes(places: DataFrame) -> DataFrame:
    """Positions (``x``, ``y`` and others) by stripe, in order of (y, x)."""
    return places.withColumn("stripe", F.floor(F.col("y") / STRIPE)).repartition("stripe").sortWithinPartitions("stripe", "y", "x")


def position_file(places: DataFrame) -> DataFrame:
    """The run's position file in parts: ``path``, ``ord``, ``content``. ``places``: the distinct positions of a run, shifted; read twice."""
    path = "Data/Intensities/s.locs"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(ranges(batches, 1)):
            x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
            ord_ = rows.column(0)[0].as_py() << 32 | n
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ord_], pa.int64()), pa.array([encode.position_bytes(x, y)], pa.binary())], names=PARTS.names)

    head = places.sparkSession.createDataFrame([(path, -1, encode.position_header(places.count()))], PARTS)
    return head.unionByName(in_stripes(places).select("stripe", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).mapInArrow(pack, PARTS))


def occupied(clusters: DataFrame) -> DataFrame:
    """Every position of the run once (``x``, ``y``, shifted), with the codes (lane * 10000 + tile) of the tiles that have a cluster there."""
    code = F.col("lane").cast("bigint") * 10_000 + F.col("tile").cast("bigint")
    return clusters.groupBy((F.col("x") + SHIFT).alias("x"), (F.col("y") + SHIFT).alias("y")).agg(F.collect_set(code).alias("tiles"))


def filter_files(places: DataFrame, lanes: list[int], tiles: list[int], controls: bool = False) -> DataFrame:
    """Filter files of all ``tiles`` of ``lanes`` in parts: for each range of positions a byte for each, 1 where the tile has a cluster.

    ``places`` as ``occupied`` gives them, read twice. With ``controls`` the control files of the
    tiles, which are empty, come along. What a task holds is a range of positions by the tiles
    of the geometry.
    """
    wanted = np.array(sorted(lane * 10_000 + tile for lane in lanes for tile in tiles), np.int64)
    names_ = [f"{CALLS}/L00{c // 10_000}/s_{c // 10_000}_{c % 10_000}" for c in wanted.tolist()]
    kinds = [("filter", 1), ("control", 2)][: 1 + controls]
    count = places.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, rows in enumerate(ranges(batches, 1)):
            lists = pa.concat_arrays(rows.column("tiles").chunks)
            row = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            code = lists.flatten().to_numpy()
            at = np.searchsorted(wanted, code).clip(0, len(wanted) - 1)
            known = wanted[at] == code
            passed = np.zeros((len(wanted), rows.num_rows), np.uint8)
            passed[at[known], row[known]] = 1
            ord_ = rows.column(0)[0].as_py() << 32 | n
            for kind, size in kinds:
                content = [p.tobytes() for p in passed] if size == 1 else [bytes(2 * rows.num_rows)] * len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array([f"{x}.{kind}" for x in names_]), pa.array([ord_] * len(wanted), pa.int64()), pa.array(content, pa.binary())], names=PARTS.names)

    head = places.sparkSession.createDataFrame([(f"{x}.{kind}", -1, encode.filter_header(count)) for kind, _ in kinds for x in names_], PARTS)
    return head.unionByName(in_stripes(places).select("stripe", "tiles").mapInArrow(pack, PARTS))


def scaled(value: Column) -> Column:
    """A coordinate as the position file holds it: tenths from the origin, single precision."""
    return ((value - ORIGIN) / 10).cast("float")


def first_read(reads: DataFrame) -> DataFrame:
    return reads.orderBy("lane", "sample", "pos").limit(1)


def run_info_reads(cycles: DataFrame) -> DataFrame:
    """Numbered reads of more than 0 cycles: ``number``, ``key``, ``cycles``, ``is_index``; ``cycles``: ord, key, cycles."""
    some = cycles.filter("cycles > 0")
    return some.select(F.row_number().over(Window.orderBy("ord")).alias("number"), "key", "cycles", F.when(F.col("key").startswith("R"), "N").otherwise("Y").alias("is_index"))


def run_info_xml(run_id: str, number: int, flowcell: str, instrument: str, date: str, reads: list, lanes: int, tiles: list[str]) -> str:
    """The run's description; ``reads`` are rows of ``run_info_reads``, ``tiles`` of ``tile_names``."""
    import xml.etree.ElementTree as X

    from lanewise.schema import SURFACES, SWATHS, TILE_HEIGHT, TILE_WIDTH, TILES

    root = X.Element("RunInfo", Version="6")
    run = X.SubElement(root, "Run", Id=run_id, Number=str(number))
    for tag, text in (("Flowcell", flowcell), ("Instrument", instrument), ("Date", date)):
        X.SubElement(run, tag).text = text
    parts = X.SubElement(run, "Reads")
    for r in reads:
        X.SubElement(parts, "Read", Number=str(r["number"]), NumCycles=str(r["cycles"]), IsIndexedRead=r["is_index"], IsReverseComplement="N")
    shape = X.SubElement(run, "FlowcellLayout", LaneCount=str(lanes), SurfaceCount=str(SURFACES), SwathCount=str(SWATHS), TileCount=str(TILES))
    if tiles:
        digits = "ThreeDigit" if len(tiles[0].split("_")[1]) == 3 else "FourDigit"
        inner = X.SubElement(X.SubElement(shape, "TileSet", TileNamingConvention=digits), "Tiles")
        for t in tiles:
            X.SubElement(inner, "Tile").text = t
    X.SubElement(run, "ImageDimensions", Width=str(TILE_WIDTH), Height=str(TILE_HEIGHT))
    channels = X.SubElement(run, "ImageChannels")
    for name in ("blue", "green"):
        X.SubElement(channels, "Name").text = name
    X.indent(root)
    return '<?xml version="1.0"?>\n' + X.tostring(root, encoding="unicode") + "\n"
