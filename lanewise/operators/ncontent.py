"""Where the undetermined bases are: by read, cycle and tile."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import names
from lanewise.runtime import checkpointed


def n_reads(reads: DataFrame) -> DataFrame:
    """``file``, ``pos``, ``tile``, ``x``, ``y``, ``cycles``: reads with an ``N``, with the places of all (from 0), of files in which their coordinates can be told.

    A file with such a read whose name has no coordinates is left out whole. ``reads`` are
    scanned once: what has an ``N`` is written to the shared folder, and files are judged there.
    """
    places = F.filter(F.transform(F.split("sequence", ""), lambda c, i: F.when(c == "N", i)), lambda i: i.isNotNull())
    some = checkpointed(reads.filter(F.col("sequence").contains("N")).select("file", "pos", names.tile_coordinates(F.col("name")).alias("at"), places.alias("cycles")))
    bad = some.filter("at is null").select("file").distinct()
    return some.join(bad, "file", "left_anti").select("file", "pos", "at.tile", "at.x", "at.y", "cycles")


def n_positions(reads: DataFrame) -> DataFrame:
    """One row for each ``N``: ``file``, ``tile``, ``x``, ``y``, ``cycle`` (from 0)."""
    return n_reads(reads).select("file", "tile", "x", "y", F.explode("cycles").alias("cycle"))


def n_count_histogram(positions: DataFrame) -> DataFrame:
    """How many clusters have how many ``N``; reads at the same place of a file count together."""
    each = positions.groupBy("file", "tile", "x", "y").agg(F.count("*").alias("n_count"))
    return each.groupBy("file", "n_count").agg(F.count("*").alias("n_sequences"))


def n_by_cycle(positions: DataFrame) -> DataFrame:
    return positions.groupBy("file", "cycle", "tile").agg(F.count("*").alias("n_count"))


def filler(positions: DataFrame) -> DataFrame:
    """Every tile of a file with every cycle from 1 to the last that has an ``N``, at 0.

    ``positions`` or their counts: file, tile, cycle. From one row per file with its tiles (their number is bounded by their four digits).
    """
    each = positions.groupBy("file").agg(F.collect_set("tile").alias("tiles"), F.max("cycle").alias("last"))
    cycles = F.when(F.col("last") >= 1, F.sequence(F.lit(1), F.col("last"))).otherwise(F.array().cast("array<int>"))
    return each.select("file", F.explode("tiles").alias("tile"), cycles.alias("cycles")).select("file", "tile", F.explode("cycles").alias("cycle"), F.lit(0).alias("n_filler"))


def n_by_cycle_filled(positions: DataFrame) -> DataFrame:
    """Counts by cycle and tile, 0 where the grid has no ``N``."""
    counts = checkpointed(n_by_cycle(positions))  # one row per file, cycle and tile
    return counts.join(filler(counts), ["file", "cycle", "tile"], "full").select(
        "file", "cycle", "tile", F.coalesce("n_count", F.col("n_filler").cast("bigint")).alias("n_count"))


def chart(data: list[dict], mark: str, x: str, y: str, color: str | None = None, log: bool = False) -> dict:
    """A Vega-Lite description of a chart over rows that have been aggregated."""
    encoding = {"x": {"field": x, "type": "quantitative"}, "y": {"field": y, "type": "quantitative", "scale": {"type": "symlog" if log else "linear"}}}
    if color:
        encoding["color"] = {"field": color, "type": "nominal"}
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "data": {"values": data}, "mark": mark, "encoding": encoding}


def drawing(data: list[dict], mark: str, x: str, y: str, color: str | None = None, log: bool = False) -> str:
    """The same chart as an SVG image: bars, or a line for each value of ``color``."""
    wide, high, left, low, palette = 720, 400, 60, 40, 12
    scale = (lambda v: math.log1p(v)) if log else float
    most_x, most_y = max([r[x] for r in data], default=0) or 1, max([scale(r[y]) for r in data], default=0) or 1
    at_x = lambda v: left + (wide - left - 10) * v / (most_x + 1)
    at_y = lambda v: high - low - (high - low - 10) * scale(v) / most_y
    parts = [f'<line x1="{left}" y1="{high - low}" x2="{wide}" y2="{high - low}" stroke="black"/>', f'<line x1="{left}" y1="0" x2="{left}" y2="{high - low}" stroke="black"/>']
    for i in range(5):
        v = most_x * i / 4
        parts.append(f'<text x="{at_x(v):.1f}" y="{high - low + 14}" font-size="10" text-anchor="middle">{v:g}</text>')
        v = math.expm1(most_y * i / 4) if log else most_y * i / 4
        parts.append(f'<text x="{left - 4}" y="{at_y(v) + 3:.1f}" font-size="10" text-anchor="end">{v:.4g}</text>')
    parts += [f'<text x="{wide / 2}" y="{high - 6}" font-size="12" text-anchor="middle">{x}</text>', f'<text x="12" y="{high / 2}" font-size="12" transform="rotate(-90 12 {high / 2})">{y}</text>']
    groups: dict = {}
    for r in data:
        groups.setdefault(r[color] if color else None, []).append((r[x], r[y]))
    for n, points in enumerate(groups.values()):
        paint = f"hsl({360 * (n % palette) // palette},70%,45%)"
        if mark == "bar":
            width = max(1.0, (wide - left - 10) / (most_x + 1) * 0.8)
            parts += [f'<rect x="{at_x(a) - width / 2:.1f}" y="{at_y(b):.1f}" width="{width:.1f}" height="{high - low - at_y(b):.1f}" fill="{paint}"/>' for a, b in points]
        else:
            parts.append(f'<polyline fill="none" stroke="{paint}" points="{" ".join(f"{at_x(a):.1f},{at_y(b):.1f}" for a, b in sorted(points))}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-family="sans-serif">\n' + "\n".join(parts) + "\n</svg>\n"
