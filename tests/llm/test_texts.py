"""Encoding, mixing and repetition against the whole encoding and plain definitions."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import bpe, mixture, repetition

PARTS = ["a", "the", " ", "  ", "\n", "'", "'re", "1", "23", "é", "漢", "!", "--", "\t", "\x1c", " ", "x" * 50, " \n ", "😀", " " * 30, "́", "<|endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(bpe.vocabulary_path())


def library():
    """The public library, whole texts at once."""
    import tiktoken

    known = bpe.load(bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=known.pattern, mergeable_ranks=known.ranks, special_tokens={})


LIBRARY = library()


@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS) | st.text(max_size=5), max_size=60), window=st.sampled_from([16, 17, 33]))
def test_windows_give_the_ids_of_the_whole_text(parts, window):
    vocabulary, text = bpe.load(bpe.vocabulary_path()), "".join(parts)
    ids = bpe.encode_text(vocabulary, text, window)
    assert ids == LIBRARY.encode_ordinary(text)
    decoder = bpe.Decoder(vocabulary)
    assert "".join([decoder.feed([i]) for i in ids]) + decoder.finish() == text


def test_long_runs_and_constant_memory(vocabulary):
    rng = random.Random(2)
    for base in ("ab", "conglomerate", "漢字", "=-", "1234567", " ", "\n", "\t  "):
        text = "".join(rng.choice([base, base[0], base[-1]]) for _ in range(30_000))
        encoder, out, held = bpe.Encoder(vocabulary, 4096), [], 0
        for at in range(0, len(text), 1000):
            out += encoder.feed(text[at : at + 1000])
            held = max(held, len(encoder.text) + len(encoder.piece))
        assert out + encoder.finish() == LIBRARY.encode_ordinary(text)
        assert held < 40_000 or base.isspace()


def test_tokens_behind_the_lookahead_never_change(vocabulary):
    rng = random.Random(3)
    assert 1000 < vocabulary.lookahead < 10_000
    letters = "etaoinshrdlu"
    for _ in range(20):
        text = "".join(rng.choice(letters) for _ in range(6000)).encode()
        whole = LIBRARY._encode_single_piece(text)
        cut = 5000
        ends = lambda ids: [sum(len(vocabulary.tokens[i]) for i in ids[:n]) for n in range(1, len(ids) + 1)]
        part = LIBRARY._encode_single_piece(text[:cut])
        keep = sum(e <= cut - vocabulary.lookahead for e in ends(part))
        assert keep and part[:keep] == whole[:keep]


def test_corpus_with_nulls_and_special_strings(spark, vocabulary):
    from tokenizers import Tokenizer

    texts = [None, "", " ", "<|endoftext|>", "Hello  wörld\r\n", "x" * 70_000, "a b " * 20_000, "same", "same"]
    df = spark.createDataFrame([(i % 8, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.encode_corpus(df, ["doc_id", "ids"], out="tokens").collect()
    plain = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = Counter((i % 8, tuple(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert Counter((r["doc_id"], tuple(r["tokens"])) for r in rows) == want
    back = bpe.decode_corpus(bpe.encode_corpus(df, ["doc_id"]), ["doc_id"]).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i % 8, t or "") for i, t in enumerate(texts))
    assert {r["tokens"] for r in bpe.count_tokens(df.limit(2), ["doc_id"]).collect()} == {0}
    assert bpe.encode_corpus(df.limit(0), ["doc_id"]).count() == 0


def test_ids_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(bpe, "SENT", 7)
    texts = ["a b c d e", None, "", "x y", "one two three four five six seven eight nine", "z"]
    rows = bpe.pa.RecordBatch.from_arrays([bpe.pa.array(range(6)), bpe.pa.array(texts)], names=["k0", "text"])
    for counts in (False, True):
        sent = list(bpe._encoded(bpe.vocabulary_path(), 64, counts)(iter([rows.slice(0, 0), rows, rows.slice(3)])))
        got = [(r["k0"], r["out"]) for b in sent for r in b.to_pylist()]
        want = [(i, LIBRARY.encode_ordinary(texts[i] or "")) for i in [*range(6), 3, 4, 5]]
        assert got == [(i, len(x) if counts else x) for i, x in want] and max(b.num_rows for b in sent) < 6


def corpus(spark, sizes):
    rng = random.Random(4)
    rows = [(n, "word " * rng.randint(1, 2 * size), s) for n, (s, size) in enumerate((s, size) for s, (docs, size) in sizes.items() for _ in range(docs))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def test_shares_meet_the_weights(spark):
    docs = corpus(spark, {"a": (400, 30), "b": (60, 20), "c": (900, 10), "other": (50, 10)}).unionByName(
        spark.createDataFrame([(9001, None, "a"), (9002, "", "a"), (9003, "x", None), (None, "x y", "c")], "doc_id long, text string, source string"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.2, 1), ("gone", 0.1, 4)], "source string, weight double, max_repeats int")
    for seed in (1, 2):
        mixed, shares = mixture.mix(docs, targets, seed=seed)
        rows = mixed.collect()
        caps = {"a": 1, "b": 3, "c": 1}
        assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
        report = {r["source"]: r for r in shares.collect()}
        whole = sum(r["tokens"] * r["copies"] for r in rows)
        for s in "abc":
            used = sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
            assert report[s]["tokens_used"] == used and abs(report[s]["actual_share"] - used / whole) < 1e-12
            assert abs(report[s]["actual_share"] - report[s]["attainable_share"]) < 0.01
        assert report["gone"]["documents_used"] == 0 and report["gone"]["actual_share"] == 0
        assert max(report[s]["tokens_used"] / (report[s]["tokens"] * caps[s]) for s in "abc") > 0.98


def test_repeats_at_the_cap_and_totals(spark):
    docs = corpus(spark, {"a": (20, 10), "b": (100, 10)})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, weight double, max_repeats int")
    mixed, _ = mixture.mix(docs, targets)
    assert {r["copies"] for r in mixed.filter("source = 'a'").collect()} == {2}
    _, shares = mixture.mix(docs, targets, total=10**9)
    assert {r["most_copies"] for r in shares.collect()} == {1, 2}
    empty, shares = mixture.mix(docs.limit(0), targets)
    assert empty.count() == 0 and {r["actual_share"] for r in shares.collect()} == {0.0}


def test_the_layout_does_not_matter(spark):
    docs = corpus(spark, {"a": (300, 30), "b": (60, 20), "c": (500, 10)})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1)], "source string, weight double, max_repeats int")
    found = [sorted(map(tuple, mixture.mix(docs.repartition(n), targets, bucket_rows=50)[0].collect())) for n in (3, 7)]
    assert found[0] == found[1]
    _, shares = mixture.mix(docs, targets, bucket_rows=50)
    report = {r["source"]: r for r in shares.collect()}
    assert all(abs(r["actual_share"] - r["attainable_share"]) < 0.01 for r in report.values())
    assert [s for s, r in report.items() if r["binding"]] == [max(report, key=lambda s: report[s]["tokens_used"] / report[s]["tokens"] / report[s]["max_repeats"])]
    assert mixture.rounds(10**6, 50) == [20_000, 800, 32, 2, 1]


def test_a_few_large_documents_do_not_spoil_the_tokens():
    rng = random.Random(8)
    tokens = sorted([5000, 4000, 900] + [rng.randint(5, 60) for _ in range(600)], reverse=True)
    taken, runs = Counter(), 1500
    for seed in range(runs):
        rng, active = random.Random(seed), []
        p = mixture.descend(tokens, 0.4, rng)
        assert abs(sum(x * t for x, t in zip(p, tokens)) - 0.4 * sum(tokens)) < 1e-3
        done = [*mixture.flight(([i, t, x] for i, (t, x) in enumerate(zip(tokens, p))), rng, active), *mixture.landing(active, rng)]
        chosen = [u[0] for u in done if u[2] == 1]
        assert abs(sum(tokens[i] for i in chosen) - 0.4 * sum(tokens)) < 200
        taken.update(chosen)
    assert all(abs(taken[i] / runs - 0.4) < 0.06 for i in range(len(tokens)))
    alike = [rng.randint(20, 60) for _ in range(300)]  # both sums stay
    p = mixture.descend(sorted(alike, reverse=True), 0.3, random.Random(1))
    assert abs(sum(p) - 90) < 1e-6 and sum(0 < x < 1 for x in p) < 60


def test_flight_keeps_chances_and_totals():
    taken, runs = Counter(), 2000
    tokens = [1, 5, 5, 9, 20, 3, 7, 7, 2, 11]
    for seed in range(runs):
        rng, active = random.Random(seed), []
        done = [*mixture.flight(([i, t, 0.3] for i, t in enumerate(tokens)), rng, active), *mixture.landing(active, rng)]
        chosen = [u[0] for u in done if u[2] == 1]
        assert len(done) == 10 and len(chosen) == 3
        taken.update(chosen)
    assert all(abs(taken[i] / runs - 0.3) < 0.04 for i in range(10))


def plain_share(text):
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text or "")]
    starts = [tuple(words[i : i + 6]) for i in range(len(words) - 5)]
    covered = {j for i, g in enumerate(starts) if g in starts[:i] for j in range(i, i + 6)}
    return len(words), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "c", "é", "1", "d-e", ".", "\n"]), max_size=60))
def test_repeated_words_against_the_definition(parts):
    text = " ".join(parts)
    words = repetition.words_of(text)
    assert (len(words), repetition.repeated_words(words)) == plain_share(text)


def test_words_of_other_scripts():
    text = "x\u00b2y \u2177z \u0130st \u01c5 \u6f22\u5b57_\u6f22 e\u0301t"
    assert repetition.words_of(text) == ["x", "y", "z", "i\u0307st", "\u01c6", "\u6f22\u5b57", "\u6f22", "e", "t"]


def test_repetition_of_unusual_tables(spark):
    texts = [None, "", "one two", "a b c d e f " * 10, "a a a a a a a", "1 2 3", "spam " * 100_000, "the quick brown fox jumps over the lazy dog once", "the quick brown fox jumps over the lazy dog once"]
    df = spark.createDataFrame([(i % 8, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, share double")
    exact = repetition.measure(df, ["doc_id"]).collect()
    want = Counter((i % 8, *plain_share(t)) if i != 6 else (6, 100_000, 99_999) for i, t in enumerate(texts))
    assert Counter(tuple(r) for r in exact) == want
    rows = repetition.repetition(df).collect()
    assert len(rows) == 9 and {r["doc_id"] for r in rows if r["repetitive"]} == {3, 4, 6}
    assert all((r["words"] is None) == (not r["candidate"]) for r in rows)
    assert all((r["doc_id"], r["words"], r["repeated"]) in want for r in rows if r["candidate"])
    assert all(r["llr"] == 0 and not r["repetitive"] for r in rows if r["doc_id"] in (1, 5))
    assert repetition.repetition(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")  # both multinomials agree
    assert not any(r["repetitive"] for r in repetition.repetition(alike).collect())


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["a", "B", "b", "c", "é", "1", ".", "\n"]), max_size=40).map(" ".join) | st.none(), max_size=8), bins=st.sampled_from([1, 7, 64]))
def test_hashed_words_are_the_repeated_ones(texts, bins):
    at, bin_, counts = repetition.hashed_grams(texts, bins)
    assert [(int(n), int((bin_[at == i] >= bins).sum())) for i, n in enumerate(counts)] == [plain_share(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_no_repetitive_document_exceeds_the_threshold(seed):
    rng, bins = random.Random(seed), rng_bins(seed)
    raw = repetition.np.array([rng.choice([0, 1, 5, 1000]) for _ in range(2 * bins)])
    target = repetition.np.array([rng.randint(0, int(n)) for n in raw])
    ratio, fresh, again = repetition.log_ratios(raw, target, bins)
    limit = max(0.6 * again + 0.4 * fresh, again) + 1e-9
    seen = [repetition.np.flatnonzero(raw[:bins]), bins + repetition.np.flatnonzero(raw[bins:])]
    for _ in range(20):
        words = rng.randint(1, 30)
        more = rng.randint(-(-6 * words // 10), words)
        if all(len(s) for s in seen):
            some = [rng.choice(seen[1]) for _ in range(more)] + [rng.choice(seen[0]) for _ in range(words - more)]
            assert ratio[some].mean() <= limit


def rng_bins(seed):
    return 1 + seed % 9


def test_the_ratio_alone_tells_most_documents(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(80)) for _ in range(300)] + [" ".join([word() for _ in range(9)] * 10) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = repetition.repetition(df).collect()
    assert {r["doc_id"] for r in rows if r["repetitive"]} == set(range(300, 320)) and sum(r["candidate"] for r in rows) < 40
