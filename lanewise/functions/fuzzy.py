"""Pattern search with an error budget: regular expressions of the JVM where they can express it, else Python's."""

from __future__ import annotations

import re
from itertools import combinations, product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schema import MATCH

#: Alternatives that a JVM pattern may have; beyond them the plain search runs in Python.
MOST_ALTERNATIVES = 600
BASES = "ACGTN"


def literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def within(text: str, errors: int) -> list[str]:
    """Patterns that together match what differs from ``text`` in at most ``errors`` places."""
    errors = min(errors, len(text))
    if not errors:
        return [literal(text)]
    return ["".join(r"[\s\S]" if i in places else literal(c) for i, c in enumerate(text)) for places in combinations(range(len(text)), errors)]


def substitutions(found: Column, text: str) -> Column:
    """In how many places a match of the same length differs from ``text``."""
    out = F.lit(0)
    for i, c in enumerate(text, start=1):
        out = out + (F.substring(found, i, 1) != c).cast("int")
    return out


def native_pattern(parts: list[str], errors: int) -> str | None:
    """A pattern with the groups of each part, once for every way to share the errors; None if too large.

    The first part is the leftmost one for which the others can follow, the last the rightmost
    (the gap is greedy); all share one budget. The ways are ordered by the errors of the first
    part, so that a better first part leaves more to the second.
    """
    if not parts or len(parts) > 2 or not all(re.fullmatch("[A-Z]+", p) for p in parts):
        return None
    ways = []
    for first in range(errors + 1):
        budgets = (errors,) if len(parts) == 1 else (first, errors - first)
        ways.append(r"[\s\S]*".join("(" + "|".join(within(p, b)) + ")" for p, b in zip(parts, budgets)))
        if len(parts) == 1:
            break
    return "|".join(ways) if sum(w.count("|") for w in ways) <= MOST_ALTERNATIVES else None


def search(sequence: Column, pattern: str, errors: int = 0, kind: str = "s") -> Column:
    """Struct of errors and captures of the leftmost match of ``pattern`` in ``sequence``, null without one.

    Parts of the pattern are joined by ``+``. ``kind``: ``s`` substitutions, ``i`` insertions,
    ``d`` deletions, ``e`` any. A null sequence has no match. Substitutions in one or two
    literal parts, and patterns without errors, run in the JVM; the others in an Arrow UDF,
    which gets only the sequences that have an undisturbed piece of each literal part.
    """
    parts = pattern.upper().split("+")
    plain = native_pattern(parts, errors) if kind in "se" and (kind == "s" or not errors) or not errors else None
    if plain:
        groups = range(1, re.compile(plain).groups + 1)
        got = [F.regexp_extract(sequence, plain, g) for g in groups]
        n = len(parts)
        captures = [F.coalesce(*[F.nullif(g, F.lit("")) for g in got[i::n]]) for i in range(n)]
        wrong = captures[0].isNull()
        total = substitutions(captures[0], parts[0])
        for c, p in zip(captures[1:], parts[1:]):
            total = total + substitutions(c, p)
        return F.when(~wrong, F.struct(total.alias("errors"), F.array(*captures).alias("captures")))
    if not errors:
        whole = "(" + ".*".join(f"({p})" for p in parts) + ")"
        groups = range(2, re.compile(whole).groups + 1)
        return F.when(sequence.rlike(whole), F.struct(F.lit(0).alias("errors"), F.array(*[F.regexp_extract(sequence, whole, g) for g in groups]).alias("captures")))
    for part in parts:
        if pieces := undisturbed(part, errors):
            sequence = F.when(sequence.rlike("|".join(pieces)), sequence)
    return python_search(pattern, errors, kind)(sequence)


def undisturbed(part: str, errors: int) -> list[str]:
    """Pieces of a literal part of which every match has one as it is: one more than errors can hit. None for short parts and for patterns."""
    if not re.fullmatch("[A-Z]+", part) or len(part) <= errors:
        return []
    borders = [len(part) * i // (errors + 1) for i in range(errors + 2)]
    return sorted({part[a:b] for a, b in zip(borders, borders[1:])})


def python_pattern(pattern: str, errors: int, kind: str) -> str:
    """The fuzzy form: each part may have the errors, and all together not more."""
    budget = f"e<={errors}" if kind == "e" else ",".join(f"{k}<={errors if k == kind else 0}" for k in "ids")
    return "(" + ".*".join(f"({p}){{{budget}}}" for p in pattern.upper().split("+")) + f"){{{budget}}}"


def python_search(pattern: str, errors: int, kind: str):
    text = python_pattern(pattern, errors, kind)

    @F.pandas_udf(MATCH)
    def find(sequences: pd.Series) -> pd.DataFrame:
        import regex

        compiled = regex.compile(text)
        out = []
        for s in sequences:
            m = compiled.search(s) if s is not None else None
            out.append((sum(m.fuzzy_counts), list(m.groups()[1:])) if m else (None, None))
        return pd.DataFrame({"errors": pd.array([e for e, _ in out], dtype="Int32"), "captures": pd.Series([c for _, c in out], dtype=object)})

    return lambda c: (lambda f: F.when(f["errors"].isNotNull(), f))(find(c))


def expand(pattern: str) -> list[str]:
    """All sequences that a simple pattern stands for: ``.`` ``*`` any base, ``[..]``, ``(a|b)``, ``(..)?``; sorted."""
    if "+" in pattern:
        raise ValueError("+ isn't supported in patterns that are expanded")
    choices: list[list[str]] = []
    for token in re.findall(r"\[[^\]]*\]|\([^)]*\)\??|.", pattern):
        if token in ".*":
            choices.append(list(BASES))
        elif token[0] == "[":
            choices.append(list(token[1:-1]))
        elif token[0] == "(":
            choices.append(token.rstrip("?")[1:-1].split("|") + ([""] if token[-1] == "?" else []))
        else:
            choices.append([token])
    return sorted({"".join(x) for x in product(*choices)})
