"""Read names, file names, lanes, and the identifiers built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a read name's parts: the seven fields before the blank, umis that may follow them, and the comment behind it.
READ_NAME = "^[A-Za-z0-9_]+:[0-9]+:[A-Za-z0-9]+(?::[0-9]+){4}"
UMIS = r"^[A-Z]+(?:\+[A-Z]+)?"
COMMENT = r"^[0-9]+:[YN]:[0-9]+(?::|\z)"
READ_NAME_FIELDS = (
    ("instrument", "string"), ("run_number", "int"), ("flowcell_id", "string"), ("lane", "int"), ("tile", "int"), ("x", "int"), ("y", "int"),
    ("umi1", "string"), ("umi2", "string"), ("read", "int"), ("is_filtered", "string"), ("control", "int"), ("barcode", "string"),
)


def left_pad(value: Column, width: int, fill: str) -> Column:
    """Padded on the left; longer values stay whole (``lpad`` would cut them)."""
    return F.when(F.length(value) < width, F.lpad(value, width, fill)).otherwise(value)


def lane_name(lane: Column) -> Column:
    """``1`` -> ``L001``, ``12`` -> ``L012``; what has four characters or more stays."""
    return left_pad(left_pad(lane, 3, "0"), 4, "L")


def tile_coordinates(name: Column) -> Column:
    """Struct of tile, x, y; null unless the part before the blank has them as its fifth to seventh field."""
    parts = F.split(F.split_part(name, F.lit(" "), F.lit(1)), ":")
    tile, x, y = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (5, 6, 7))
    return F.when(tile.isNotNull() & x.isNotNull() & y.isNotNull(), F.struct(tile.alias("tile"), x.alias("x"), y.alias("y")))


def read_name_fields(name: Column, strict: bool = True, only: tuple[str, ...] | None = None) -> Column:
    """Struct of the thirteen parts, or of those in ``only``; absent umi and comment are null. A name of another form raises, or gives null if not strict."""
    core, comment = F.split(F.split_part(name, F.lit(" "), F.lit(1)), ":"), F.split_part(name, F.lit(" "), F.lit(2))
    umi = F.split(F.nullif(F.regexp_extract(F.get(core, F.lit(7)), UMIS, 0), F.lit("")), r"\+")
    told = F.when(comment.rlike(COMMENT), F.split(comment, ":"))
    places = [F.get(core, F.lit(i)) for i in range(6)] + [F.regexp_extract(F.get(core, F.lit(6)), "^[0-9]+", 0), F.get(umi, F.lit(0)), F.get(umi, F.lit(1))] + [F.get(told, F.lit(i)) for i in range(4)]
    parts = [F.nullif(c, F.lit("")).cast(kind).alias(field) for c, (field, kind) in zip(places, READ_NAME_FIELDS) if not only or field in only]
    whole = F.when(name.rlike(READ_NAME), F.struct(*parts))
    bad = F.raise_error(F.concat(F.lit("read name of an unknown form: "), F.coalesce(name, F.lit("null"))))
    return F.coalesce(whole, bad) if strict else whole


def barcode(name: Column, strict: bool = True) -> Column:
    """The last field of the part after the blank; a name without one raises, or gives null if not strict."""
    comment = F.split_part(name, F.lit(" "), F.lit(2))
    bad = F.raise_error(F.concat(F.lit("read name without barcode: "), F.coalesce(name, F.lit("null"))))
    found = F.when(name.contains(" "), F.element_at(F.split(comment, ":"), -1))
    return found.otherwise(bad) if strict else found


def lane_of_file(file: Column) -> Column:
    """The third part of a file name between underscores, which must be a lane."""
    lane = F.split_part(F.element_at(F.split(file, "/"), -1), F.lit("_"), F.lit(3))
    return F.when(lane.rlike(r"^L\d{3}$"), lane).otherwise(F.raise_error(F.concat(F.lit("file name without lane: "), file)))


def input_type(file: Column) -> Column:
    return F.when(file.rlike(r"\.f(ast)?q(\.gz)?$"), "FASTQ").when(file.rlike(r"\.f(ast)?a(\.gz)?$"), "FASTA")


def sample_of_file(file: Column) -> Column:
    """A FASTQ file's name without the part for the read and the ending."""
    return F.regexp_replace(F.regexp_replace(file, r"_[RI][1-4]_", "_"), r"\.fastq(\.gz)?$", "")


def lane_part(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"_(L00[1-9])_", 1), F.lit(""))


def run_id(day: Column, instrument: Column, run: Column, flowcell: Column) -> Column:
    return F.concat(F.date_format(day, "yyMMdd"), instrument, F.lit("_"), left_pad(run.cast("string"), 4, "0"), F.lit("_"), flowcell)


def cycle_key(key: Column) -> Column:
    """``Read1Cycles`` -> ``R1``, ``Index2Cycles`` -> ``I2``."""
    return F.regexp_replace(F.regexp_replace(key, r"^(R)ead|^(I)ndex", "$1$2"), r"Cycles$", "")


def read_extension(index1: Column, index2: Column, extended: bool) -> Column:
    none = F.lit(" 1:N:0:" + "N" * 8 if extended else "")
    return F.when(F.coalesce(index1, F.lit("")) == "", none).otherwise(
        F.concat(F.lit(" 1:N:0:"), index1, F.when(F.coalesce(index2, F.lit("")) != "", F.concat(F.lit("+"), index2)).otherwise("")))
