import random

import pytest
import regex
from pyspark.sql import functions as F

from lanewise.functions import fuzzy
from lanewise.operators import mixing, ncontent, search

SHEET = "Lane string, Sample_Project string, index1 string, index2 string"
BARCODES = "Lane string, Undetermined_Index string, Count long, Fraction double"


def fits(index, text):
    return any(sum(a != b for a, b in zip(index, text[i : i + len(index)])) <= 1 for i in range(len(text) - len(index) + 1))


@pytest.mark.parametrize(("sheet", "found", "hit"), [
    (("L001", "P", "ACGTACGT", "TTTTTTTT"), ("L002", "ACGTACGT+TTTTTTTT"), True),
    (("L001", "P", "ACGTACGT", "TTTTTTTT"), ("L001", "ACGTACGT+TTTTTTTT"), False),
    (("L001", "P", "ACGTACGT", "TTTTTTTT"), ("L002", "ACGAACGT+TTTTTTTT"), True),
    (("L001", "P", "ACGTACGT", "TTTTTTTT"), ("L002", "ACGAACGA+TTTTTTTT"), False),
    (("L001", "P", "ACGTACGT", None), ("L002", "ACGTACGT"), True),
    (("L001", "P", "AAAAAAAA", "TTTTTTTT"), ("L002", "CCCCCCCC+GGGGGGGG"), False),
    (("L001", "P", "ACGTA", None), ("L002", "ACGT+A"), True),
    (("L001", "P", "", None), ("L002", "ACGT"), True),
    (("L001", "P", "ACGTACGT", None), ("L002", "ACGT"), False),
    (("L001", "P", None, None), ("L002", "ACGT"), False),
])
def test_cases(spark, sheet, found, hit):
    got = mixing.index_mixing(spark.createDataFrame([sheet], SHEET), spark.createDataFrame([(*found, 3, 0.5)], BARCODES))
    assert got.count() == hit
    assert got.columns == ["Lane", "Undetermined_Index", "Count", "Fraction", "Sample_Project", "Lane_Project", "index1", "index2"]


def test_masked_join_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("AC") for _ in range(n))
    sheet = [(f"L00{rng.randint(1, 3)}", f"P{i % 4}", word(rng.choice([0, 3, 5, 6])), rng.choice([None, word(4)])) for i in range(40)] * 2
    found = [(f"L00{rng.randint(1, 3)}", word(6) + "+" + word(5), rng.randint(1, 9), 0.25) for _ in range(40)] + [("L001", None, 1, 0.1)]
    found += found[:3]
    want = sorted(str((b[0], b[1], b[2], s[1], s[0], s[2], s[3])) for s in sheet for b in found if b[1] and s[0] != b[0] and fits(s[2], b[1]) and (s[3] is None or fits(s[3], b[1])))
    got = mixing.index_mixing(spark.createDataFrame(sheet, SHEET), spark.createDataFrame(found, BARCODES)).drop("Fraction").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert mixing.index_mixing(spark.createDataFrame([], SHEET), spark.createDataFrame(found, BARCODES)).count() == 0


def test_runs_are_kept_apart(spark):
    sheet = spark.createDataFrame([(1, "L001", "P", "ACGTACGT", None), (2, "L002", "Q", "TTTTTTTT", None)], "run_id int, " + SHEET)
    found = spark.createDataFrame([(1, "L002", "ACGTACGA", 3, 0.5), (2, "L001", "ACGTACGT", 2, 0.5), (2, "L001", "TTTTTTTT+A", 1, 0.5)], "run_id int, " + BARCODES)
    hits = mixing.index_mixing(sheet, found, ["run_id"])
    assert sorted(map(tuple, hits.select("run_id", "Undetermined_Index", "Sample_Project").collect())) == [(1, "ACGTACGA", "P"), (2, "TTTTTTTT+A", "Q")]
    own = spark.createDataFrame([(2, "L001", "Z", "TTTTTTTT", "A")], "run_id int, " + SHEET)
    assert mixing.unexpected(hits, own, ["run_id"]).count() == 2


def test_counting_cutting_and_cleaning(spark):
    names = ["Undetermined_S0_L001_R1_001.fastq.gz"] * 3
    reads = spark.createDataFrame([(f, i, f"a:1:f:1:1101:1:1 1:N:0:{b}") for i, (f, b) in enumerate(zip(names, ["ACGTACGT+TGCATGCA", "ACGTACGT+TGCATGCA", "CCCCCCCC+GGGGGGGG"]))], "file string, pos long, name string")
    rows = mixing.top_barcodes(mixing.undetermined(reads)).collect()
    assert [tuple(r)[1:] for r in rows] == [("L001", "ACGTACGT+TGCATGCA", 2, 2 / 3)]
    many = spark.range(3000).select(F.lit("f").alias("file"), F.lit("L001").alias("Lane"), F.concat(F.lit("A"), F.pmod("id", F.lit(1500)).cast("string")).alias("Undetermined_Index"), F.col("id").alias("pos"))
    cut = mixing.top_barcodes(many)
    assert cut.count() == 1000 and cut.agg(F.max(F.substring("Undetermined_Index", 2, 9).cast("int"))).first()[0] == 999
    hits = spark.createDataFrame([("L001", "x", 3, 0.1, "P", "L002", "AA", "CC"), ("L001", "x", 3, 0.1, "Q", "L003", "AA", None), ("L001", "y", 2, 0.2, "P", "L002", "GG", "CC")], BARCODES + ", Sample_Project string, Lane_Project string, index1 string, index2 string")
    sheet = spark.createDataFrame([("L001", "Z", "AA", "CC"), ("L001", "Z", "AA", None)], SHEET)
    left = mixing.unexpected(hits, sheet)
    assert sorted(r["Sample_Project"] for r in left.collect()) == ["P", "Q"]
    assert [(r["Lane"], r["Lane_Count"], round(r["Lane_Fraction"], 9)) for r in mixing.by_lane(hits).collect()] == [("L001", 5, 0.3)]
    assert {r["Undetermined_Index"]: r["Sample_Project"] for r in mixing.by_barcode(hits).collect()} == {"x": ["P", "Q"], "y": ["P"]}


@pytest.mark.parametrize(("pattern", "errors", "kind"), [
    ("ACGT", 0, "s"), ("ACGT", 1, "s"), ("ACGT", 2, "s"), ("ACG+TTA", 0, "s"), ("ACG+TTA", 1, "s"), ("ACG+TTA", 2, "s"), ("A[CG]T", 0, "s"),
    ("ACT", 1, "i"), ("ACGT", 1, "d"), ("ACGT", 1, "e"), ("ACGTAC", 2, "e"), ("ACG+TTA", 1, "e"), ("ACG+T[AC]A", 1, "d"), ("(A|C)GT+TT", 0, "s"), ("A[CG]TA", 1, "s"), ("acgt", 1, "s"),
])
def test_search_agrees_with_the_fuzzy_engine(spark, pattern, errors, kind):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["TCGTACGT", None, ""]
    compiled = regex.compile(fuzzy.python_pattern(pattern, errors, kind))
    want = [(m := compiled.search(t)) and (sum(m.fuzzy_counts), list(m.groups()[1:])) if t is not None else None for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, sequence string")
    got = [r["m"] and (r["m"]["errors"], r["m"]["captures"]) for r in df.select("id", fuzzy.search(F.col("sequence"), pattern, errors, kind).alias("m")).orderBy("id").collect()]
    assert got == want


@pytest.mark.parametrize(("pattern", "n"), [("A.T", 5), ("[ACG]T", 3), ("(A|C)GT", 2), ("(A)?GT", 2), ("(AA|CC)T", 2), ("A..", 25), ("A(C|G)", 2)])
def test_expansion(pattern, n):
    assert len(fuzzy.expand(pattern)) == n


def test_pieces_that_errors_leave():
    assert fuzzy.undisturbed("ACGTAC", 1) == ["ACG", "TAC"] and fuzzy.undisturbed("AAAA", 1) == ["AA"]
    assert fuzzy.undisturbed("AC", 2) == fuzzy.undisturbed("A[CG]", 1) == []


def test_patterns_kept_apart(spark):
    with pytest.raises(ValueError):
        fuzzy.expand("A+C")
    assert search.safe_distance(spark, ["AAAA", "TTTT"], 5) == 1
    with pytest.raises(ValueError):
        search.safe_distance(spark, ["A.", "AA"], 0)


def test_reports(spark):
    rows = [(1, 0, ["ACGT", "TTTT"], 10, 3, 0.10), (1, 0, ["ACGG", "TTTT"], 5, 1, 0.05), (1, 1, ["ACGT", "TT"], 2, 9, 0.02)]
    counts = spark.createDataFrame(rows, "pattern_no int, errors int, captures array<string>, cnt long, first long, share double")
    assert [r["line"] for r in search.match_report(counts).orderBy("line_no").collect()] == ["0 ACGT TTTT 10 10.00%", "0 ACGG TTTT 5 5.00%", "1 ACGT TT   2 2.00%"]
    assert [r["line"] for r in search.error_report(search.error_totals(counts, 1, 2, 100)).orderBy("line_no").collect()] == ["0 15 15.00%", "1 2 2.00%", "2 0 0.00%"]


def test_n_content(spark):
    at = "i:1:f:1:{}:{}:2 1:N:0:A"
    reads = [("a", 0, at.format(1101, 5), "NACN"), ("a", 1, at.format(1102, 6), "AN"), ("a", 2, at.format(1102, 7), "ACGT"), ("a", 3, "odd", "ACGT"), ("b", 0, "odd", "AN"), ("b", 1, at.format(1, 1), "N"), ("c", 0, None, None)]
    positions = ncontent.n_positions(spark.createDataFrame(reads, "file string, pos long, name string, sequence string"))
    assert sorted(map(tuple, positions.collect())) == [("a", 1101, 5, 2, 0), ("a", 1101, 5, 2, 3), ("a", 1102, 6, 2, 1)]
    assert ncontent.filler(positions).count() == 2 * 3
    filled = {(r["tile"], r["cycle"]): r["n_count"] for r in ncontent.n_by_cycle_filled(positions).collect()}
    assert filled == {(1101, 0): 1, (1101, 1): 0, (1101, 2): 0, (1101, 3): 1, (1102, 1): 1, (1102, 2): 0, (1102, 3): 0}
    assert sorted((r["n_count"], r["n_sequences"]) for r in ncontent.n_count_histogram(positions).collect()) == [(1, 1), (2, 1)]
