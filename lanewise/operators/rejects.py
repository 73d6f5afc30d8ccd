"""Lines of a comma-separated export: typed rows, and the lines that can't be read with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.runtime import fresh_name, written

FIELDS = ("read_no", "name", "sequence", "quality", "sample")
#: Possessive, so that long fields are matched in a loop and not by recursion.
FIELD = '(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
QUOTED = rf"^{FIELD}(?:,{FIELD})*+\z"
BARCODE = r"[ACGTN]+(?:\+[ACGTN]+)?"
NAME = rf"^[A-Za-z0-9]{{3,}}:[0-9]+:[A-Za-z0-9]+:[1-8]:[12][1-4][01][0-9]:[0-9]+:[0-9]+(?::{BARCODE})? [12]:[YN]:[0-9]+:{BARCODE}\z"
#: What a value of each column must match by itself.
VALID = {"read_no": r"^[0-9]+\z", "name": NAME, "sequence": r"^[ACGTN]+\z", "quality": r"^[!-~]*\z"}


def unquoted(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def structure(df: DataFrame, line: str, parts: str, fields: str, reason: str) -> DataFrame:
    """``df`` with the fields of each line as a struct (null unless there are five), and the structural reason or null.

    The line is matched once and taken apart once; a comma put before it keeps every match of a
    field from being empty. The parts are a projection of their own, so that they aren't
    computed again for each field.
    """
    text = F.col(f"`{line}`")
    split = F.when(text.rlike(QUOTED), F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(f",({FIELD})"), F.lit(1)))
    five = F.size(parts) == len(FIELDS)
    struct = F.struct(*[unquoted(F.get(parts, F.lit(i))).alias(f) for i, f in enumerate(FIELDS)])
    broken = F.when(text.isNull(), "columns").when(F.col(parts).isNull(), "quoting").when(~five, "columns")
    return df.withColumn(parts, split).withColumns({fields: F.when(five, struct), reason: broken}).drop(parts)


def prints(*of: Column) -> list[Column]:
    """128 bits that stand for the values of ``of``."""
    return [F.xxhash64(*of), F.xxhash64(F.lit(1), *of)]


def values(parsed: DataFrame, fields: str, *keep: Column) -> DataFrame:
    """``place`` (of the column in VALID) and ``value`` of the columns that are judged, beside ``keep``: rows of five fields only."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"{fields}.{f}").alias("value")) for i, f in enumerate(VALID)])
    return parsed.select(*keep, F.inline(F.when(F.col(fields).isNotNull(), each)))  # a filter would take the lines apart once more


def value_dictionary(parsed: DataFrame, fields: str) -> DataFrame:
    """Each distinct invalid value once: ``h1``, ``h2`` (of place and value), ``place``.

    The distinct values of all columns come from one exchange, combined map-side, and are judged
    behind it, each once. That they are counted keeps the judgement there: a filter on grouping
    columns alone would be moved in front of the exchange, to each row's value.
    """
    distinct = values(parsed, fields).groupBy("place", "value").agg(F.count("*").alias("n"))
    valid = F.lit(True)
    for i, pattern in enumerate(VALID.values()):
        valid = F.when(F.col("place") == i, F.col("value").rlike(pattern)).otherwise(valid)
    h1, h2 = prints(F.col("place"), F.col("value"))
    return distinct.filter(F.when(F.col("n") > 0, ~valid)).select(h1.alias("h1"), h2.alias("h2"), "place")


def judge(df: DataFrame, line: str = "line") -> DataFrame:
    """``df`` with ``fields`` (struct of the five texts), ``reason`` and ``detail``.

    ``reason`` is null for a valid line, else ``quoting``, ``columns`` or ``value``, the first
    that applies; ``fields`` is null unless the line has five. A null line has no columns, an
    empty one has one column; repeated lines are judged alike; an empty table gives none. If
    ``df`` has columns of these names, the new ones get trailing underscores.

    Each distinct value of a column is judged once. The invalid ones are put into a dictionary,
    with the column they don't fit, and joined back to the rows' values by 128-bit hashes; the
    lines with such a value, by hashes too, are joined to the rows beside the check that quality
    and sequence are equally long, which concerns two columns. Both tables are written, so that
    the planner knows their sizes when it chooses how to join; hot keys of sort-merge joins are
    split by AQE. ``df`` is read three times and must give the same rows each time.
    """
    fields, reason, detail, a, b, place, parts = (fresh_name(df, x) for x in ("fields", "reason", "detail", "__a", "__b", "__place", "__parts"))
    text = F.col(f"`{line}`")
    rows = structure(df, line, parts, fields, reason)
    words = written(value_dictionary(rows, fields))
    l1, l2 = prints(text)
    h1, h2 = prints(F.col("place"), F.col("value"))
    hashed = values(rows, fields, l1.alias("l1"), l2.alias("l2")).select("l1", "l2", h1.alias("h1"), h2.alias("h2"))
    bad = written(hashed.join(words, ["h1", "h2"]).groupBy("l1", "l2").agg(F.min("place").alias(place)))
    rows = rows.withColumns({a: l1, b: l2})
    rows = rows.join(bad, (F.col(a) == F.col("l1")) & (F.col(b) == F.col("l2")), "left")
    uneven = F.length(f"{fields}.quality") != F.length(f"{fields}.sequence")
    final = F.coalesce(F.col(reason), F.when(F.col(place).isNotNull() | uneven, "value"))
    wrong = F.concat(F.get(F.array(*map(F.lit, VALID)), F.col(place)), F.lit(" doesn't match its form"))
    why = F.when(F.col(reason).isNull(), F.coalesce(wrong, F.when(uneven, "quality isn't as long as sequence")))
    return rows.withColumns({detail: why, reason: final}).select(*df.columns, fields, reason, detail)


def typed(judged: DataFrame, keep: list[str]) -> DataFrame:
    """The valid rows of ``judge``: ``keep`` and the fields, cast; ``name`` also in its parts.

    Numbers of more digits than their type holds come out as null beside the text of ``name``;
    a name without umi has a null ``umi``.
    """
    good = judged.filter(F.col("reason").isNull()).withColumns({
        "core": F.split(F.split_part("fields.name", F.lit(" "), F.lit(1)), ":"), "told": F.split(F.split_part("fields.name", F.lit(" "), F.lit(2)), ":")})
    core = lambda i: F.get("core", F.lit(i))
    told = lambda i: F.get("told", F.lit(i))
    return good.select(
        *keep, F.col("fields.read_no").try_cast("decimal(38,0)").alias("read_no"), F.col("fields.name").alias("name"),
        core(0).alias("instrument"), core(1).try_cast("bigint").alias("run"), core(2).alias("flowcell"), core(3).try_cast("int").alias("lane"),
        core(4).try_cast("int").alias("tile"), core(5).try_cast("bigint").alias("x"), core(6).try_cast("bigint").alias("y"), core(7).alias("umi"),
        told(0).try_cast("int").alias("read"), told(1).alias("filtered"), told(2).try_cast("bigint").alias("control"), told(3).alias("barcode"),
        F.col("fields.sequence").alias("sequence"), F.col("fields.quality").alias("quality"), F.col("fields.sample").alias("sample"),
    )
