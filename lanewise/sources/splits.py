"""Large FASTQ files read in ranges of bytes: plain ones, and those compressed in blocks (gzip members that name their size)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lanewise.schema import READ
from lanewise.sources.files import ARROW, BATCH, batch, opened

CHUNK = 1 << 20
#: First bytes of a block: gzip with an extra field that holds its size in the subfield BC.
MAGIC, SIZE = b"\x1f\x8b\x08\x04", struct.Struct("<4xI2xH2sHH")
RANGES = "path string, start long, stop long"


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with ``head``, 0 if none does."""
    if len(head) < SIZE.size or head[:4] != MAGIC:
        return 0
    _, _, tag, length, size = SIZE.unpack_from(head)
    return size + 1 if (tag, length) == (b"BC", 2) else 0


def splittable(path: str) -> bool:
    if not path.endswith(".gz"):
        return True
    system, inner = opened(path)
    with system.open_input_stream(inner, compression=None) as raw:
        return block_size(raw.read(SIZE.size)) > 0


def contents(path: str, start: int, stop: int | None = None) -> Iterator[bytes]:
    """What lies between two places of a file: its bytes, or the contents of the blocks that begin there; to the end without ``stop``."""
    system, inner = opened(path)
    with system.open_input_file(inner) as raw:
        end = raw.size() if stop is None else min(stop, raw.size())
        if not path.endswith(".gz"):
            raw.seek(start)
            while start < end and (some := raw.read(min(CHUNK, end - start))):
                start += len(some)
                yield some
            return
        at = next_block(raw, start)
        while at is not None and at < end:
            raw.seek(at)
            size = block_size(raw.read(SIZE.size))
            raw.seek(at)
            yield zlib.decompress(raw.read(size), wbits=31)
            at = at + size if at + size < raw.size() else None


def next_block(raw: pa.NativeFile, start: int) -> int | None:
    """Where the first block at or behind ``start`` begins: one whose successors are blocks too, to the end or four times."""
    held, base = b"", start
    raw.seek(start)
    while some := raw.read(CHUNK):
        held += some
        found = held.find(MAGIC)
        while found >= 0:
            at, good = base + found, 0
            while good < 5 and at < raw.size():
                raw.seek(at)
                size = block_size(raw.read(SIZE.size))
                if not size:
                    break
                at, good = at + size, good + 1
            if good == 5 or good and at == raw.size():
                return base + found
            found = held.find(MAGIC, found + 1)
        keep = held[-(len(MAGIC) - 1) :]
        base, held = base + len(held) - len(keep), keep
        raw.seek(base + len(keep))
    return None


def lines_from(path: str, start: int) -> Iterator[str]:
    rest = b""
    for some in contents(path, start):
        *whole, rest = (rest + some).split(b"\n")
        for line in whole:
            yield line.rstrip(b"\r").decode()
    if rest:
        yield rest.rstrip(b"\r").decode()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line ends of each range, and whether it ends with one (null if it holds nothing)."""
    for some in batches:
        ends, last = [], []
        for path, start, stop in zip(*(c.to_pylist() for c in some.columns)):
            n, byte = 0, b""
            for part in contents(path, start, stop):
                n, byte = n + part.count(b"\n"), part[-1:] or byte
            ends.append(n)
            last.append(byte == b"\n" if byte else None)
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(ends, pa.int64()), pa.array(last, pa.bool_())], names=[*some.schema.names, "ends", "last"])


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin in each range. The number of its first line tells which lines begin records, so quality lines are never mistaken."""
    for some in batches:
        for path, start, first, lines, skip in zip(*(c.to_pylist() for c in some.columns)):
            text = islice(lines_from(path, start), skip + -first % 4, None)
            held: list[tuple] = []
            for pos in range(-(-first // 4), -(-(first + lines) // 4)):
                name, sequence, plus, quality = (next(text, None) for _ in range(4))
                if not name and sequence is None:
                    break  # a blank line at the end
                if not name or name[:1] != "@" or plus is None or plus[:1] != "+" or quality is None or len(quality) != len(sequence):
                    raise ValueError(f"{path}: record {pos} isn't FASTQ")
                held.append((path, pos, name[1:], sequence, quality))
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)
    yield pa.RecordBatch.from_pylist([], schema=ARROW)


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], size: int) -> DataFrame:
    """The records of ``files`` (path, bytes) with the schema READ, a task for each ``size`` bytes.

    Each file is read twice: the first time only line ends are counted, of which the driver gets
    a number for each range. From them follow the number of a range's first line and with it
    the places of its records, so ``pos`` counts from 0 in each file.
    """
    ranges = [(path, at, min(at + size, whole)) for path, whole in files for at in range(0, whole, size)]
    some = spark.sparkContext.defaultParallelism
    split = lambda rows, schema, n: spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, n)), schema)
    told = split(ranges, RANGES, min(len(ranges), 64 * some)).mapInArrow(counted, RANGES + ", ends long, last boolean").toArrow().to_pylist()
    work, now, line, fresh = [], None, 0, True
    for r in sorted(told, key=lambda r: (r["path"], r["start"])):
        if r["path"] != now:
            now, line, fresh = r["path"], 0, True
        if r["last"] is None:
            continue
        begun = r["ends"] + fresh - bool(r["last"])  # lines that begin in the range
        work.append((now, r["start"], line + (not fresh), begun, int(not fresh)))
        line, fresh = line + r["ends"], r["last"]
    rows = split(work, "path string, start long, first long, lines long, skip int", len(work))
    return rows.mapInArrow(parsed, READ)
