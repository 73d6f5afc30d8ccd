"""Repeated content inside each document: a hashed n-gram log-likelihood ratio picks documents, an exact comparison decides."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a stretch, and the share from which a document counts as repetitive.
STRETCH = 6
SHARE = 0.6
#: Largest share of the documents that form the trusted target.
TRUSTED = 0.1
#: Bins into which n-grams are hashed: so many for fresh words and as many for repeated ones. Fewer n-grams in a bin make its ratio less sure.
BINS = 256
#: Raw n-grams added to the target's counts, so that what it lacks has a finite ratio.
PRIOR = 10
#: Characters of the texts that are hashed together.
TOGETHER = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The longest runs of letters of any script, lower case."""
    if text.isascii():
        return LETTERS.findall(text.lower())
    out = []
    for word in LETTERS.findall(text):
        if word.isalpha():
            out.append(word.lower())
        else:  # numerals that aren't decimal digits pass the pattern
            out += ["".join(w).lower() for w in _letter_runs(word)]
    return out


def _letter_runs(text: str) -> Iterator[list[str]]:
    run: list[str] = []
    for c in text:
        if c.isalpha():
            run.append(c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def repeated_words(words: list[str], stretch: int = STRETCH) -> int:
    """Words that lie in a stretch which also begins at an earlier word; one pass, linear memory."""
    seen: set[tuple[str, ...]] = set()
    repeated = end = 0
    for at, gram in enumerate(zip(*(islice(words, i, None) for i in range(stretch)))):
        if gram in seen:
            repeated += at + stretch - max(at, end)
            end = at + stretch
        else:
            seen.add(gram)
    return repeated


def exact_words(text: str | None, stretch: int = STRETCH) -> tuple[int, int]:
    words = words_of(text) if text else []
    return len(words), repeated_words(words, stretch)


def _texts(df: DataFrame, keep: list[str], text: str, work: Callable, schema: str) -> DataFrame:
    """``work(text) -> tuple`` of each row, through Arrow, beside the kept columns."""
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    width = len(schema.split(","))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            new = [pa.array([r[i] for r in found]) if found else pa.array([], pa.int64()) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], *[f"n{i}" for i in range(width)]])

    kinds = [x.split() for x in schema.split(",")]
    out = rows.mapInArrow(task, ", ".join([f"k{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1])] + [f"n{i} {t}" for i, (_, t) in enumerate(kinds)]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"n{i}").alias(n) for i, (n, _) in enumerate(kinds)])


def measure(df: DataFrame, keep: list[str], text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """``keep``, ``words`` and ``repeated`` (numbers of words) of each row's text; no shuffle.

    A null, empty or wordless text has 0 words, one with fewer than ``stretch`` words 0 repeated
    ones. Repeated rows stay, an empty table gives none; columns not in ``keep`` are dropped.
    """

    return _texts(df, keep, text, lambda value: exact_words(value, stretch), "words bigint, repeated bigint")


def hashed_grams(texts: list[str], bins: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: the place of their text, and the bin of their n-gram; and the number of words of each text.

    A word's n-gram is the stretch that begins there (near the end of a text its last one, in a
    shorter text the word alone). Bins from ``bins`` on are those of words in a stretch whose
    64-bit hash also begins earlier in the text. Equal stretches have equal hashes, so every
    repeated word is among them; a few others may be, as hashes may agree by chance.
    """
    lists = [words_of(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    total, size = int(counts.sum()), stretch - 1
    word = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for x in lists for w in x), np.uint64, total)
    text = np.repeat(np.arange(len(lists)), counts)
    at = word * np.uint64(0x9E3779B97F4A7C15)
    covered = np.zeros(total, bool)
    if total > size:
        gram = np.zeros(total - size, np.uint64)
        for j in range(stretch):
            gram = gram * np.uint64(0xD1342543DE82EF95) + word[j : total - size + j] + np.uint64(1)
        gram ^= gram >> np.uint64(31)
        gram *= np.uint64(0x9E3779B97F4A7C15)
        inside = np.flatnonzero(text[: total - size] == text[size:])
        own = gram[inside] ^ (text[inside].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
        order = np.argsort(own, kind="stable")  # equal ones in their order
        again = inside[order[1:]][own[order[1:]] == own[order[:-1]]]
        steps = np.bincount(again, minlength=total + stretch) - np.bincount(again + stretch, minlength=total + stretch)
        covered = np.cumsum(steps)[:total] > 0
        last = np.repeat(np.cumsum(counts) - stretch, counts)
        begin = np.minimum(np.arange(total), last)
        long = np.repeat(counts >= stretch, counts)
        at[long] = gram[begin[long]]
    return text, ((at >> np.uint64(33)) % np.uint64(bins)).astype(np.int64) + bins * covered, counts


def log_ratios(raw: np.ndarray, target: np.ndarray, bins: int) -> tuple[np.ndarray, float, float]:
    """Log ratio of target to raw of each bin, cut off at the pooled ratios of fresh and of repeated words; and those two.

    The target's counts are smoothed by PRIOR n-grams of the raw multinomial. Without any word
    all are 0.
    """
    part = raw / max(1, raw.sum())
    smooth = (target + PRIOR * part) / (target.sum() + PRIOR)
    halves = slice(0, bins), slice(bins, 2 * bins)
    pooled = [float(np.log(smooth[h].sum() / part[h].sum())) if raw[h].any() else 0.0 for h in halves]
    ratio = np.repeat(pooled, bins)
    seen = raw > 0
    ratio[seen] = np.minimum(ratio[seen], np.log(smooth[seen] / part[seen]))
    return ratio, *pooled


def runs_of(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of the texts that hold about ``size`` characters, a longer text alone."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and held + n > size:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def repetition(df: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE, stretch: int = STRETCH, trusted: float = TRUSTED, bins: int = BINS) -> DataFrame:
    """``id``, ``llr``, ``candidate``, ``words``, ``repeated``, ``share``, ``repetitive`` of every document.

    Every word counts with its hashed n-gram (see ``hashed_grams``), in one bin if it is fresh
    and in another if it repeats an earlier stretch. Two multinomials over the bins are counted:
    the trusted target's (documents whose hashed share is at most ``trusted``) and the raw
    corpus's (all). ``llr`` is the document's log-likelihood ratio of target to raw, divided by
    its words; ``candidate`` is what doesn't exceed the threshold, and only candidates are
    compared exactly: for others ``words``, ``repeated`` and ``share`` are null and ``repetitive``
    false. The threshold is that of a document with the share ``share`` all of whose bins have
    the largest ratio of their kind. As ratios are cut off at the pooled ratio of their kind, a
    document with that share or more can't exceed it, so none is lost, whatever the corpus;
    where target and raw agree, all are candidates.

    A null, empty or wordless text has an llr of 0 and no words, and isn't repetitive. Repeated
    rows count each time, an empty table gives none; other columns are ignored. Texts are read
    twice and never shuffled: counting sends at most ``2 * bins`` rows per task and to the
    driver, scoring a table of as many numbers to each task.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2 * bins), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in runs_of(texts, TOGETHER):
                at, bin_, words = hashed_grams(texts[a:b], bins, stretch)
                good = np.bincount(at, weights=bin_ >= bins, minlength=b - a) <= trusted * words
                sums[0] += np.bincount(bin_, minlength=2 * bins)
                sums[1] += np.bincount(bin_[good[at]], minlength=2 * bins)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["bin", "raw", "target"])

    parts = rows.select("text").mapInArrow(count, "bin bigint, raw bigint, target bigint")
    got = parts.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    sums = np.zeros((2, 2 * bins))
    sums[:, got["bin"].to_numpy()] = [got["raw"].to_numpy(), got["target"].to_numpy()]
    ratio, fresh, again = log_ratios(*sums, bins)
    limit = max(share * again + (1 - share) * fresh, again) + 1e-9

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            llr = np.zeros(len(texts))
            for a, b in runs_of(texts, TOGETHER):
                at, bin_, words = hashed_grams(texts[a:b], bins, stretch)
                llr[a:b] = np.bincount(at, weights=ratio[bin_], minlength=b - a) / np.maximum(1, words)
            exact = [exact_words(t, stretch) if near else (None, None) for t, near in zip(texts, llr <= limit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(llr), *[pa.array([x[i] for x in exact], pa.int64()) for i in (0, 1)]], names=["id", "llr", "words", "repeated"])

    found = rows.mapInArrow(score, f"id {dict(rows.dtypes)['id']}, llr double, words bigint, repeated bigint")
    part = F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).when(F.col("words") == 0, 0.0)
    return found.select(
        F.col("id").alias(id), "llr", F.col("words").isNotNull().alias("candidate"), "words", "repeated", part.alias("share"),
        F.coalesce((F.col("words") > 0) & (part >= share), F.lit(False)).alias("repetitive"))
