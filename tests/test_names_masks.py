import pytest
from pyspark.sql import functions as F

from lanewise.functions import masks, names
from lanewise.operators import sheets

# masks and their numbers, in the order of masks.FIELDS
MASKS = {
    "Y151": (0, 0, 151, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), "Y151;I10;I10;Y151": (0, 0, 151, 0, 0, 10, 0, 0, 0, 10, 0, 0, 151, 0),
    "Y151;I0;I0;Y151": (0, 0, 151, 0, 0, 0, 0, 0, 0, 0, 0, 0, 151, 0), "Y151;I8N2;Y151": (0, 0, 151, 0, 0, 8, 2, 0, 0, 0, 0, 0, 151, 0),
    "Y151;N1I8N2;Y151": (0, 0, 151, 0, 1, 8, 2, 0, 0, 0, 0, 0, 151, 0), "U8Y143;I10;I10;Y151": (8, 0, 143, 0, 0, 10, 0, 0, 0, 10, 0, 0, 151, 0),
    "Y151;Y151": (0, 0, 151, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), "U8Y143;I10;I10;U5Y146": (8, 0, 143, 0, 0, 10, 0, 5, 0, 10, 0, 0, 146, 0),
    "N1Y100;I8;I8U9;U8N2Y90N1": (9, 1, 100, 0, 0, 8, 0, 8, 0, 8, 0, 2, 90, 1), "Y151;U9;I8;Y151": (9, 0, 151, 0, 0, 0, 0, 0, 0, 8, 0, 0, 151, 0), "Y100Y100": (0, 0, 100, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
}
SAMPLE_MASKS = {
    "Y28;I8;I8;Y28": (0, 0, 28, 0, 0, 8, 0, 0, 0, 8, 0, 0, 28, 0), "Y30;I8": (0, 0, 30, 0, 0, 8, 0, 0, 0, 0, 0, 0, 0, 0),
    "U4Y28;I8N2;N1I8;U3Y26N1": (4, 0, 28, 0, 0, 8, 2, 3, 1, 8, 0, 0, 26, 1), "N1Y30;I8;Y31": (0, 1, 30, 0, 0, 8, 0, 0, 0, 0, 0, 0, 31, 0),
    "N1Y20;I8;I8U9;U8N2Y16N1": (9, 1, 20, 0, 0, 8, 0, 8, 0, 8, 0, 2, 16, 1), "Y32;I8;I8;Y32": (0, 0, 32, 0, 0, 8, 0, 0, 0, 8, 0, 0, 32, 0),
}

DUAL = """[Header]
FileFormatVersion,2
[Reads]
Read1Cycles,151
Index1Cycles,10
Index2Cycles,10
Read2Cycles,151
{marker}
Lane,Sample_ID,Sample_Name,index,index2,Sample_Project,OverrideCycles
1,S1,n1,GAACTGAGCG,TCGTGGAGCG,A,Y151;I10;I10;Y151
12,S2,n2,AAGTCCAAGC,CACCGCACAC,A,Y151;I10;I10;Y151

2,S3,n3,CGTCTCATAT,TATAGTAGCT,B,Y151;I10;I10;Y151
[Cloud]
a,b
"""


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict(recursive=True)


@pytest.mark.parametrize(("lane", "want"), [("1", "L001"), ("12", "L012"), ("123", "L123"), ("1234", "1234"), ("L001", "L001"), ("", "L000"), (None, None)])
def test_lane(spark, lane, want):
    assert one(spark, a=names.lane_name(F.lit(lane).cast("string")))["a"] == want


def test_read_names(spark):
    name = "VH1:12:FC1:3:2101:1000:2000:ACG+TTT 1:N:0:ACGT+TGCA"
    got = one(spark, f=names.read_name_fields(F.lit(name)), c=names.tile_coordinates(F.lit(name)), b=names.barcode(F.lit(name)))
    assert got["f"] == dict(instrument="VH1", run_number=12, flowcell_id="FC1", lane=3, tile=2101, x=1000, y=2000, umi1="ACG", umi2="TTT", read=1, is_filtered="N", control=0, barcode="ACGT+TGCA")
    assert got["c"] == dict(tile=2101, x=1000, y=2000) and got["b"] == "ACGT+TGCA"
    short = one(spark, f=names.read_name_fields(F.lit("VH1:12:FC1:3:2101:1:2")), c=names.tile_coordinates(F.lit("a-b:1:c:1:x:1:2")), d=names.tile_coordinates(F.lit("a:b")), n=names.tile_coordinates(F.lit(None).cast("string")))
    assert short["f"]["umi1"] is None and short["f"]["barcode"] is None and short["c"] is short["d"] is short["n"] is None
    odd = one(spark, f=names.read_name_fields(F.lit("VH_1:12:FC1:3:2101:1:2:RST 2:Y:18:")))["f"]
    assert (odd["instrument"], odd["y"], odd["umi1"], odd["umi2"], odd["read"], odd["is_filtered"], odd["control"], odd["barcode"]) == ("VH_1", 2, "RST", None, 2, "Y", 18, None)
    for bad in (names.read_name_fields(F.lit("nothing")), names.barcode(F.lit("VH1:1")), names.lane_of_file(F.lit("a_b_L1_c"))):
        with pytest.raises(Exception, match="USER_RAISED|form|barcode|lane"):
            one(spark, a=bad)
    assert one(spark, a=names.read_name_fields(F.lit("nothing"), strict=False))["a"] is None


@pytest.mark.parametrize(("file", "want"), [("a.fastq.gz", "FASTQ"), ("a.fq", "FASTQ"), ("a.fa", "FASTA"), ("a.fasta.gz", "FASTA"), ("a.txt", None)])
def test_input_type(spark, file, want):
    assert one(spark, a=names.input_type(F.lit(file)))["a"] == want


def test_masks(spark):
    known = MASKS | SAMPLE_MASKS
    df = spark.createDataFrame([(m,) for m in known] + [(None,)], "mask string")
    got = {r["mask"]: r["m"] and tuple(r["m"]) for r in df.select("mask", masks.parse_mask(F.col("mask")).alias("m")).collect()}
    assert got == known | {None: None}
    assert all(tuple(masks.parsed(spark, m).values()) == v for m, v in SAMPLE_MASKS.items())
    with pytest.raises(ValueError):
        masks.parsed(spark, "Y151;I10;I10;Y151;Y50")
    with pytest.raises(Exception, match="more than four"):
        one(spark, a=masks.parse_mask(F.lit("Y151;I10;I10;Y151;Y50")))


@pytest.mark.parametrize("marker", ["[Data]", "[BCLConvert_Data]"])
def test_sheet(spark, marker):
    text = DUAL.format(marker=marker)
    rows = sheets.read_sheet(spark, text)
    assert [r["Sample_Project"] for r in rows.collect()] == ["A", "A", "B"]
    assert [r["Lane"] for r in sheets.mixing_sheet(rows).collect()] == ["L001", "L012", "L002"]
    assert sheets.read_cycles(text) == {"R1": 151, "I1": 10, "I2": 10, "R2": 151}
    table = {r["sample"]: r for r in sheets.masks_table(rows).collect()}
    assert set(table) == {"n1_S1_L001_001", "n2_S2_L012_001", "n3_S3_L002_001"} and table["n1_S1_L001_001"]["I1"] == "GAACTGAGCG"
    single = sheets.read_sheet(spark, "[Data]\nLane,Sample_Project,index\n1,A,ACGT\n")
    assert single.first()["index2"] is None


def test_rows_by_their_headers(spark):
    lines = [(1, 1, "[Data],,"), (1, 2, 'index2 ,"Sample_ID",Lane,Lane'), (1, 3, '"a, ""b""",s1,1,9'), (1, 4, ",s2"), (2, 1, "[Data]"), (2, 2, "Sample_ID"), (2, 3, "s3"), (3, 1, "[Reads]"), (3, 2, "151")]
    df = spark.createDataFrame(lines, "sheet_id long, line_no int, line string")
    rows = sheets.named_rows(df, ("Lane", "Sample_ID", "index2"))
    assert sorted(map(tuple, rows.collect())) == [(1, 3, "1", "s1", 'a, "b"'), (1, 4, None, "s2", None), (2, 3, None, "s3", None)]
    assert sheets.named_rows(df, ("Sample_ID",), ("Lane",)).count() == 2
    assert sheets.named_rows(df.limit(0), ("Lane",)).count() == 0


def test_sheet_errors(spark):
    with pytest.raises(ValueError, match="no section"):
        sheets.read_sheet(spark, "[Header]\na,b\n")
    with pytest.raises(ValueError, match="Lane"):
        sheets.read_sheet(spark, "[Data]\nSample_ID,index\n1,2\n")
    with pytest.raises(ValueError, match="no samples"):
        sheets.read_sheet(spark, "[Data]\nLane,Sample_Project,index\n")
    wrong = sheets.read_sheet(spark, DUAL.format(marker="[Data]").replace("GAACTGAGCG", "ACGT"))
    with pytest.raises(Exception, match="Index 1"):
        sheets.masks_table(wrong).collect()
    assert sheets.masks_table(wrong, strict=False).count() == 2
