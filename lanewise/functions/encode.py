"""Base calls and positions as the instrument's binary files hold them."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import ORIGIN

# fixed values of the file format: two bits of a base, two of a quality bin
BASE_CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
QUALITY_CODES = {0: 0, 9: 1, 24: 2, 40: 3}
OFFSET = 33
GZIP_LEVEL = 5


def nibble(base: Column, quality: Column) -> Column:
    """Code of a call: quality bin times 4 plus base; other qualities and bases are 0."""
    value = F.ascii(quality) - OFFSET
    q = F.when(value == 9, 1).when(value == 24, 2).when(value == 40, 3).otherwise(0)
    b = F.when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(0)
    return q * 4 + b


def _table(codes: dict, shift: int = 0) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for k, v in codes.items():
        out[ord(k) if isinstance(k, str) else k + OFFSET] = v << shift
    return out


BASES, QUALITIES = _table(BASE_CODES), _table(QUALITY_CODES, 2)


def _placed(texts: pa.Array, width: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters of each text as rows of ``width``, and the texts' lengths; what is longer is cut, what is missing is 0."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    sizes = np.diff(ends)
    data = texts.buffers()[2]
    marks = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    out = np.zeros((len(texts), width), np.uint8)
    within = np.arange(len(marks)) - np.repeat(ends[:-1] - ends[0], sizes)
    row, kept = np.repeat(np.arange(len(texts)), sizes), within < width
    out[row[kept], within[kept]] = codes[marks[kept]]
    return out, sizes


def call_codes(sequences: pa.Array, qualities: pa.Array, cycles: int) -> np.ndarray:
    """Codes of the calls, a row for each cycle and a column for each cluster; 0 behind the end of a sequence."""
    bases, sizes = _placed(sequences, cycles, BASES)
    if sizes.max(initial=0) > cycles:
        raise ValueError(f"a read is longer than {cycles} cycles")
    marks, _ = _placed(qualities, cycles, QUALITIES)
    return ((bases | marks) * (np.arange(cycles) < sizes[:, None])).T


def packed(codes: np.ndarray) -> np.ndarray:
    """Two clusters in a byte, the first in the high half; the half left over by an odd number is 0. Works on the last axis."""
    if codes.shape[-1] % 2:
        codes = np.concatenate([codes, np.zeros((*codes.shape[:-1], 1), np.uint8)], axis=-1)
    return codes[..., 0::2] << 4 | codes[..., 1::2]


def unpacked(raw: bytes, clusters: int) -> np.ndarray:
    """The codes of a block; the inverse of ``packed``."""
    both = np.frombuffer(raw, np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).reshape(-1)[:clusters]


def cycle_bytes(sequences: list[str], qualities: list[str], cycles: int) -> np.ndarray:
    """Packed calls, one row of bytes for each cycle. Clusters that end before a cycle are 0 there."""
    return packed(call_codes(pa.array(sequences, pa.string()), pa.array(qualities, pa.string()), cycles))


def unpack(block: bytes, clusters: int) -> list[tuple[str, int]]:
    """Base and quality of each cluster in a block; the inverse of ``cycle_bytes``."""
    bases, marks = "ACGT", list(QUALITY_CODES)
    return [(bases[c & 3], marks[c >> 2]) for c in unpacked(block, clusters).tolist()]


def compress(block: bytes) -> bytes:
    """With a fixed time stamp, so that equal blocks are equal files."""
    return gzip.compress(block, GZIP_LEVEL, mtime=0)


def cbcl_header(tiles: list[tuple[int, int, int, int]]) -> bytes:
    """Header of a cycle file; ``tiles`` holds tile, clusters, plain and compressed size of each block."""
    bins = struct.pack("<8I", *[x for pair in enumerate(QUALITY_CODES) for x in pair])
    body = b"".join(struct.pack("<4I", *t) for t in tiles)
    size = 48 + 16 * len(tiles) + 1
    return struct.pack("<HLBBI", 1, size, 2, 2, len(QUALITY_CODES)) + bins + struct.pack("<I", len(tiles)) + body + b"\1"


def read_cbcl(content: bytes) -> dict[int, tuple[int, bytes]]:
    """Clusters and plain block of each tile of a cycle file."""
    _, size, _, _, bins = struct.unpack_from("<HLBBI", content)
    at = 12 + 8 * bins
    (count,) = struct.unpack_from("<I", content, at)
    out, start = {}, size
    for i in range(count):
        tile, clusters, _, packed = struct.unpack_from("<4I", content, at + 4 + 16 * i)
        out[tile] = (clusters, gzip.decompress(content[start : start + packed]))
        start += packed
    return out


def position_header(count: int) -> bytes:
    return struct.pack("<IfI", 1, 1.0, count)


def position_bytes(x: np.ndarray, y: np.ndarray) -> bytes:
    """Coordinates as the position file holds them: tenths from the origin, single precision."""
    return np.stack([(x - ORIGIN) / 10, (y - ORIGIN) / 10], axis=1).astype("<f4").tobytes()


def read_positions(content: bytes) -> list[tuple[float, float]]:
    return [tuple(map(float, p)) for p in np.frombuffer(content, "<f4", offset=12).reshape(-1, 2)]


def filter_header(clusters: int) -> bytes:
    """Of filter and of control files, which have a byte and two for each position."""
    return struct.pack("<III", 0, 3, clusters)


def read_filter(content: bytes) -> list[int]:
    return list(content[12:])


def control_bytes(clusters: int) -> bytes:
    return filter_header(clusters) + bytes(2 * clusters)
