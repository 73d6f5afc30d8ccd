"""Corpus encoding with a public byte-level BPE vocabulary, as a bounded-lookahead transducer."""

from __future__ import annotations

import base64
import codecs
import importlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters that a transducer holds at most before it emits what is stable.
WINDOW = 32_768
#: Ids that are decoded at once.
IDS = 16_384
#: Ids, and pre-tokens with their ids, that a task keeps at most before it sends or forgets them.
SENT, KNOWN = 1 << 18, 1 << 16
#: The longest alternative of the pattern that looks at single characters (a contraction).
REACH = 3


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary files are."""
    return str(importlib.import_module("public_tokenizers").path(name))


@lru_cache(maxsize=4)
def load(path: str) -> "Vocabulary":
    return Vocabulary(path)


class Vocabulary:
    """Ranks of a byte-level BPE file, its pre-token pattern and its sufficient lookahead."""

    def __init__(self, path: str):
        import regex

        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}
        self.pattern = importlib.import_module("public_tokenizers").PATTERN
        # the encoder's \s is the Unicode property, which leaves out U+001C to U+001F
        self.pieces = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, list[int]] = {}
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    @property
    def lookahead(self) -> int:
        if not hasattr(self, "_lookahead"):
            self._lookahead = sufficient_lookahead(self.ranks)
        return self._lookahead


def sufficient_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes behind a token's end after which no continuation of the text can change the token.

    New text can only undo a merge if it makes an earlier merge possible that overlaps it, and
    the undone merge only touches those that come after it in the list. A change therefore
    runs leftwards along a chain of merges of rising rank, in which a proper end of each
    token's bytes begins the token before it in the chain. The longest such chain, in bytes,
    plus one token, bounds the reach. It is found in one pass over the list by rank, keeping
    for each byte string the longest chain whose last token begins with it.
    """
    longest: dict[bytes, int] = {}
    reach = 1
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        size = len(token)
        if size < 2:
            continue
        chain = max([size, *(longest[end] + i for i in range(1, size) if (end := token[i:]) in longest)])
        reach = max(reach, chain)
        for i in range(1, size + 1):
            if longest.get(start := token[:i], 0) < chain:
                longest[start] = chain
    return reach + max(map(len, ranks), default=0)


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of a pre-token's bytes: of all neighbours that form a token, those of the lowest rank are merged first, the leftmost of equal ones."""
    if piece in ranks:
        return [ranks[piece]]
    size = len(piece)
    ends, before = list(range(1, size + 1)), list(range(-1, size))  # by the byte at which a part begins
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        middle = ends[i]
        if not middle or middle >= size or ends[middle] != end:
            continue  # a part of this pair has been merged since
        ends[i], ends[middle] = end, 0
        if end < size:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heappush(heap, (r, i, ends[end]))
        if i and (r := ranks.get(piece[before[i] : end])) is not None:
            heappush(heap, (r, before[i], end))
    out, at = [], 0
    while at < size:
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Encoder:
    """Streaming transducer from text to ids: ``feed`` emits the tokens that can't change any more.

    Text of any length takes the same way. It holds at most one window of text: pre-tokens that
    are decided leave when it is full, and of a single pre-token longer than the window the
    merges further from its end than the merge list's sufficient lookahead leave. The ids are
    those of the whole text at once.
    """

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW):
        self.vocabulary, self.window = vocabulary, max(window, 16)
        self.text = ""
        self.piece = b""  # bytes of a pre-token whose beginning has been emitted
        self.kind = ""  # and its class of characters

    def feed(self, text: str) -> list[int]:
        self.text += text
        out: list[int] = []
        while len(self.text) > self.window:
            if self.kind:
                self._more(out)
            else:
                self._cut(out)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.kind:
            n = self._run(self.text, self.kind)
            self._end(out, n - (self.kind == "s" and n < len(self.text)))
        self._emit(out, self.vocabulary.pieces.findall(self.text))
        self.text = ""
        return out

    def _emit(self, out: list[int], pieces: list[str]) -> None:
        known, ranks = self.vocabulary.known, self.vocabulary.ranks
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                if len(known) >= KNOWN:
                    known.clear()
                ids = known[piece] = merged(ranks, piece.encode("utf-8", "replace"))
            out += ids

    def _cut(self, out: list[int]) -> None:
        """Emits the pre-tokens of the window that no further text can change: not the last one, nor what may become a contraction."""
        pieces = self.vocabulary.pieces.findall(self.text)
        at = len(self.text)
        while pieces and (at == len(self.text) or at - len(pieces[-1]) + REACH > len(self.text)):
            at -= len(pieces.pop())
        while pieces and at + REACH > len(self.text):
            at -= len(pieces.pop())
        if pieces:
            self._emit(out, pieces)
            self.text = self.text[at:]
            return
        # one undecided pre-token fills the window
        first = self.text[1] if self.text[0] == " " and self._kind(self.text[1]) != "s" else self.text[0]
        self.kind, self.piece = self._kind(first), b""
        self._more(out)

    def _kind(self, c: str) -> str:
        return next(k for k, p in _classes().items() if p.match(c))

    def _run(self, text: str, kind: str) -> int:
        m = _classes()[kind].match(text)
        return m.end() if m else 0

    def _more(self, out: list[int]) -> None:
        # the blank that begins a pre-token counts with it; the last blank of a run may belong to the next
        lead = not self.piece and self.kind != "s" and self.text[0] == " "
        n = lead + self._run(self.text[lead:], self.kind)
        held = self.kind == "s"
        if n == len(self.text):
            self.piece += self.text[: n - held].encode()
            self.text = self.text[n - held :]
            self._stable(out)
        else:
            self._end(out, n - held)

    def _stable(self, out: list[int]) -> None:
        ids = merged(self.vocabulary.ranks, self.piece)
        rest = len(self.piece) - self.vocabulary.lookahead
        at = i = 0
        while i < len(ids) and at + len(self.vocabulary.tokens[ids[i]]) <= rest:
            at += len(self.vocabulary.tokens[ids[i]])
            i += 1
        out += ids[:i]
        self.piece = self.piece[at:]

    def _end(self, out: list[int], n: int) -> None:
        self.piece += self.text[:n].encode()
        self.text = self.text[n:]
        out += merged(self.vocabulary.ranks, self.piece) if self.piece else []
        self.piece, self.kind = b"", ""


@lru_cache(maxsize=1)
def _classes() -> dict:
    import regex

    return {"s": regex.compile(r"\p{White_Space}+"), "L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "o": regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")}


class Decoder:
    """Streaming transducer from ids back to text; holds the bytes of one unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.bytes = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.bytes.decode(b"".join([self.tokens[i] for i in ids]))

    def finish(self) -> str:
        return self.bytes.decode(b"", final=True)


def encode_text(vocabulary: Vocabulary, text: str, window: int = WINDOW) -> list[int]:
    encoder, out = Encoder(vocabulary, window), []
    for at in range(0, len(text), window):
        out += encoder.feed(text[at : at + window])
    return out + encoder.finish()


def windows(value: pa.Scalar, window: int) -> Iterator[str]:
    """A text in parts of ``window`` bytes, decoded one by one out of the batch's buffer."""
    raw, decoder = memoryview(value.as_buffer() or b""), codecs.getincrementaldecoder("utf-8")(errors="replace")
    for at in range(0, len(raw), window):
        yield decoder.decode(raw[at : at + window], at + window >= len(raw))


def _encoded(path: str, window: int, counts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            ids, ends, begin = array("i"), array("i", [0]), 0

            def send(stop: int) -> pa.RecordBatch:
                if counts:
                    last = pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(begin, stop - begin)
                return pa.RecordBatch.from_arrays([*rows.columns[:-1], last], names=[*batch.schema.names[:-1], "out"])

            for row, value in enumerate(batch.column(batch.num_columns - 1)):
                encoder, size = Encoder(vocabulary, window), ends[-1]
                for part in windows(value, window):
                    some = encoder.feed(part)
                    size += len(some)
                    if not counts:
                        ids.extend(some)
                some = encoder.finish()
                ends.append(size + len(some))
                if not counts:
                    ids.extend(some)
                if ends[-1] >= SENT:
                    yield send(row + 1)
                    ids, ends, begin = array("i"), array("i", [0]), row + 1
            if begin < batch.num_rows or not batch.num_rows:
                yield send(batch.num_rows)

    return task


def _apply(df: DataFrame, keep: list[str], text: str, out: str, kind: str, vocabulary: str | None, window: int) -> DataFrame:
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = ", ".join([f"k{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1])] + [f"out {kind}"])
    done = rows.mapInArrow(_encoded(vocabulary or vocabulary_path(), window, kind == "bigint"), schema)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("out").alias(out))


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", out: str = "ids", vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """``keep`` and the token ids (``array<int>``) of ``text``, without special tokens; one row per row of ``df``.

    The id list is empty for a null and for an empty text; strings that look like special
    tokens are ordinary text. Repeated rows stay, an empty table gives none, columns that
    aren't in ``keep`` are dropped. ``vocabulary`` is the path of a rank file. Rows stream
    through Arrow batches without a shuffle, and every text through the transducer in parts of
    ``window`` bytes; besides the row's own ids a task holds a window, the lookahead and a
    bounded number of ids and known pre-tokens.
    """
    return _apply(df, keep, text, out, "array<int>", vocabulary, window)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "tokens", vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """As ``encode_corpus``, with the number of tokens (``bigint``, 0 for null and empty texts)."""
    return _apply(df, keep, text, out, "bigint", vocabulary, window)


def decode_corpus(df: DataFrame, keep: list[str], ids: str = "ids", out: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` and the text of ``ids``; the empty text for an empty or null list.

    Bytes that form no character come out as U+FFFD; an id without a token raises KeyError.
    """
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{ids}`").alias("ids"))
    path = vocabulary or vocabulary_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(path)
        for batch in batches:
            texts = []
            for value in batch.column(batch.num_columns - 1):
                decoder = Decoder(known)
                ids = value.values.to_numpy(zero_copy_only=False).tolist() if value.is_valid else []
                texts.append("".join([decoder.feed(ids[at : at + IDS]) for at in range(0, len(ids), IDS)]) + decoder.finish())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "out"])

    schema = ", ".join([f"k{i} {t}" for i, (_, t) in enumerate(rows.dtypes[:-1])] + ["out string"])
    return rows.mapInArrow(task, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("out").alias(out))
