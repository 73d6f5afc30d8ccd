"""Directory trees as tables: listing, parsing a listing, and creating what it names."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.schema import ENTRY


def extract(spark: SparkSession, source: str) -> DataFrame:
    """``ord``, ``path`` (relative to the folder above ``source``), ``kind`` (``dir`` or ``file``): each folder, then its files."""
    top = Path(source).resolve()
    rows = []
    for folder, inner, files in os.walk(top):
        inner.sort()
        rows.append((str(Path(folder).relative_to(top.parent)), "dir"))
        rows += [(str(Path(folder, f).relative_to(top.parent)), "file") for f in sorted(files)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows, start=1)], ENTRY)


def kind_of(path: Column, tag: Column) -> Column:
    """The given tag if it is known; else a file if the last part has a suffix or is .DS_Store."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(tag.isin("dir", "file"), tag).when((last == ".DS_Store") | last.rlike(r"^.+\.[^.]+$"), "file").otherwise("dir")


def parse(lines: DataFrame) -> DataFrame:
    """``ord``, ``path``, ``kind`` of a listing's lines (``ord``, ``line``): path, and a tag after the last tab; blank lines are left out."""
    text = F.btrim("line")
    parts = F.split(text, "\t")
    tag = F.when(F.size(parts) > 1, F.btrim(F.element_at(parts, -1)))
    path = F.btrim(parts[0])
    return lines.filter(F.coalesce(text, F.lit("")) != "").select("ord", path.alias("path"), kind_of(path, tag).alias("kind"))


def create(listing: DataFrame, target: str) -> None:
    """Folders and empty files of a listing below ``target``, in its order; existing files are kept. Runs on the driver."""
    for row in listing.orderBy("ord").toLocalIterator():
        at = Path(target, row["path"])
        try:
            if row["kind"] == "dir":
                at.mkdir(parents=True, exist_ok=True)
            else:
                at.parent.mkdir(parents=True, exist_ok=True)
                at.touch()
        except OSError as e:
            raise OSError(f"can't create {at}: {e}") from e


def clean(folder: str) -> None:
    """A file or a folder with all it holds, removed."""
    at = Path(folder)
    shutil.rmtree(at) if at.is_dir() and not at.is_symlink() else at.unlink()
