"""Sequence files as Spark data sources: ``fastq`` and ``fasta`` to read and write, ``blobs`` to write binary files."""

from __future__ import annotations

import fnmatch
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lanewise.schema import FILE, READ

BATCH = 8192
#: Bytes of a file that a task reads, where files can be split.
SPLIT = 128 << 20
ARROW = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("sequence", pa.string()), ("quality", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sized(path: str, glob: str) -> list[tuple[str, int]]:
    """Files below ``path`` whose name fits ``glob`` (hidden ones too), or the file itself, with their bytes; sorted."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob))


def listed(path: str, glob: str) -> list[str]:
    return [name for name, _ in sized(path, glob)]


def lines_of(path: str) -> Iterator[str]:
    """Lines of a plain or gzip file, with either kind of line end."""
    system, inner = opened(path)
    with system.open_input_stream(inner, compression="gzip" if inner.endswith(".gz") else None) as raw:
        rest = b""
        while block := raw.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield line.rstrip(b"\r").decode()
        if rest:
            yield rest.rstrip(b"\r").decode()


def fastq_records(path: str) -> Iterator[tuple[str, str, str]]:
    """Name, sequence and quality by groups of four lines; what doesn't fit raises ValueError with its place."""
    lines = lines_of(path)
    for n, name in enumerate(lines):
        if not name and (name := next(lines, None)) is None:
            return  # a blank line at the end
        sequence, plus, quality = next(lines, None), next(lines, None), next(lines, None)
        if name[:1] != "@" or plus is None or plus[:1] != "+" or quality is None or len(quality) != len(sequence):
            raise ValueError(f"{path}: record {n} isn't FASTQ")
        yield name[1:], sequence, quality


def fasta_records(path: str) -> Iterator[tuple[str, str, None]]:
    name, parts = None, []
    for line in lines_of(path):
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts), None
            name, parts = line[1:], []
        elif line and name is None:
            raise ValueError(f"{path}: text before the first header")
        else:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts), None


@dataclass
class OneFile(InputPartition):
    path: str


class Reader(DataSourceReader):
    """A task for each file; records leave as Arrow batches in file order. With the option ``below`` files of more bytes are left out if they can be split."""

    def __init__(self, options: dict, records, glob: str):
        self.path, self.glob, self.records, self.below = options["path"], options.get("glob", glob), records, options.get("below")

    def partitions(self) -> list[OneFile]:
        from lanewise.sources.splits import splittable

        found = sized(self.path, self.glob)
        return [OneFile(p) for p, size in found if self.below is None or size <= int(self.below) or not splittable(p)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for pos, record in enumerate(self.records(partition.path)):
            held.append((partition.path, pos, *record))
            if len(held) == BATCH:
                yield batch(held)
                held = []
        if held:
            yield batch(held)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    """Files named by the first column of the rows, below the path; they appear when the whole job has succeeded.

    A task writes under a name of its own, so that attempts don't meet; the driver moves the
    files of those that count. Rows of one file must be in one task, in their order.
    """

    def __init__(self, path: str, form):
        self.path, self.form, self.spare = path.rstrip("/"), form, f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.path)
        attempt = f"{base}/{self.spare}/{uuid.uuid4().hex}"
        moves: dict[str, str] = {}
        now, out = None, None
        try:
            for batch in batches:
                texts = self.form(batch)
                for name, run in groupby(enumerate(batch.column(0).to_pylist()), key=itemgetter(1)):
                    if name != now:
                        if out:
                            out.close()
                        now = name
                        if now in moves:
                            raise ValueError(f"rows of {now} aren't together; repartition and sort by file")
                        at = f"{attempt}/{len(moves)}" + (".gz" if now.endswith(".gz") else "")
                        system.create_dir(attempt, recursive=True)
                        moves[now] = at
                        out = system.open_output_stream(at, compression="gzip" if now.endswith(".gz") and self.form is not raw else None)
                    out.write(b"".join([texts[i] for i, _ in run]))
        finally:
            if out:
                out.close()
        return Written([(a, f"{base}/{name}") for name, a in moves.items()])

    def commit(self, messages: list) -> None:
        system, base = opened(self.path)
        ends = [end for m in messages if m for _, end in m.moves]
        if len(ends) != len(set(ends)):
            self.abort(messages)
            raise ValueError("a file was written by several tasks; repartition by file")
        for m in messages:
            for start, end in m.moves if m else ():
                system.create_dir(end.rpartition("/")[0], recursive=True)
                system.move(start, end)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, base = opened(self.path)
        if system.get_file_info(f"{base}/{self.spare}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.spare}")


def fastq_text(rows: pa.RecordBatch) -> list[bytes]:
    return [f"@{n}\n{s}\n+\n{q}\n".encode() for n, s, q in zip(*(rows.column(c).to_pylist() for c in ("name", "sequence", "quality")))]


def fasta_text(rows: pa.RecordBatch) -> list[bytes]:
    return [f">{n}\n{s}\n".encode() for n, s in zip(*(rows.column(c).to_pylist() for c in ("name", "sequence")))]


def raw(rows: pa.RecordBatch) -> list[bytes]:
    return rows.column("content").to_pylist()


class FastqSource(DataSource):
    """Options: ``path``, ``glob`` (by default ``*.f*q*``)."""

    records, form, glob = staticmethod(fastq_records), staticmethod(fastq_text), "*.f*q*"

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        return READ

    def reader(self, schema) -> Reader:
        return Reader(self.options, self.records, self.glob)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.form)


class FastaSource(FastqSource):
    records, form, glob = staticmethod(fasta_records), staticmethod(fasta_text), "*.f*a*"

    @classmethod
    def name(cls) -> str:
        return "fasta"


class BlobSource(DataSource):
    """Binary files out of rows of ``path`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return "blobs"

    def schema(self):
        return FILE

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], raw)


def register(spark: SparkSession) -> None:
    for source in (FastqSource, FastaSource, BlobSource):
        spark.dataSource.register(source)


def read_sequences(spark: SparkSession, path: str, glob: str | None = None, split: int = SPLIT) -> DataFrame:
    """Reads of a file or of all matching files below a folder; FASTA or FASTQ by the file name.

    Plain and block-compressed FASTQ files of more than ``split`` bytes are read in ranges of so
    many; other gzip files can't be.
    """
    from lanewise.sources import splits

    register(spark)
    kind = "fasta" if fnmatch.fnmatch(glob or path, "*.f*a") or fnmatch.fnmatch(glob or path, "*.f*a.gz") else "fastq"
    reader = spark.read.format(kind).option("path", path)
    reader = reader.option("glob", glob) if glob else reader
    large = [(p, size) for p, size in sized(path, glob or FastqSource.glob) if size > split and splits.splittable(p)] if kind == "fastq" else []
    if not large:
        return reader.load()
    return reader.option("below", split).load().unionByName(splits.read_ranges(spark, large, split))


def write_sequences(rows: DataFrame, path: str, kind: str = "fastq") -> None:
    """Rows of file, pos, name, sequence and quality into the files they name, in order of ``pos``."""
    register(rows.sparkSession)
    rows.select("file", "pos", "name", "sequence", "quality").repartition("file").sortWithinPartitions("file", "pos").write.format(kind).mode("append").save(path)


def write_blobs(files: DataFrame, path: str) -> None:
    """Binary files out of rows of ``path`` and ``content``, or of their parts in order of ``ord``."""
    register(files.sparkSession)
    if "ord" in files.columns:
        files = files.repartition("path").sortWithinPartitions("path", "ord")
    files.select("path", "content").write.format("blobs").mode("append").save(path)


def exists(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def is_file(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type == fs.FileType.File


def remove(path: str) -> None:
    """A file or a folder with all it holds."""
    system, inner = opened(path)
    system.delete_dir(inner) if is_folder(path) else system.delete_file(inner)


def create(path: str, append: bool = False) -> io.TextIOWrapper:
    """A text file to write, gzip by its name; with ``append`` behind what it holds."""
    system, inner = opened(path)
    start = system.open_append_stream if append and exists(path) else system.open_output_stream
    return io.TextIOWrapper(start(inner, compression="gzip" if inner.endswith(".gz") else None), encoding="utf-8", newline="")


def make_folder(path: str) -> None:
    system, inner = opened(path)
    system.create_dir(inner, recursive=True)


def read_text(path: str) -> str:
    system, inner = opened(path)
    with system.open_input_stream(inner, compression=None) as raw:
        return raw.read().decode()


def write_text(path: str, text: str) -> None:
    with create(path) as out:
        out.write(text)
