"""Whole tools over files: a synthetic flowcell, rewound and read back; reports; trees; options."""

import csv
import gzip
import json
import random
import re
import struct
import zlib
from xml.etree import ElementTree

import pytest

from lanewise import cli
from lanewise.functions import encode
from lanewise.sources import files, tree

SHEET = """[Header]
[Reads]
Read1Cycles,{r1}
Index1Cycles,10
Index2Cycles,10
Read2Cycles,30
[BCLConvert_Data]
Lane,Sample_ID,Sample_Name,index,index2,Sample_Project,OverrideCycles
1,Sample_a,a,GAACTGAG,TCGTGGAG,P,U4Y26;I8N2;I8N2;U3Y27
1,Sample_b,b,AAGTCCAA,CACCGCAC,P,N1Y30;I8N2;I8N2;Y30
2,Sample_c,c,CGTCTCAT,,Q,Y31;I8N2
"""


def test_a_submitted_tool_keeps_its_master(monkeypatch):
    import pyspark
    from pyspark.sql import SparkSession

    class Builder:
        seen = None

        def __getattr__(self, name):
            return lambda *a: setattr(self, "seen", a[0] if name == "master" else self.seen) or self

        def getOrCreate(self):
            raise InterruptedError(self.seen)

    for known, want in ((True, "None"), (False, "local[3]")):
        monkeypatch.setattr(pyspark, "SparkConf", lambda known=known: type("C", (), {"contains": lambda self, key: known})())
        monkeypatch.setattr(SparkSession, "builder", Builder())
        with pytest.raises(InterruptedError, match=re.escape(want)):
            OWN_SESSION(3)


OWN_SESSION = cli.session


@pytest.fixture(autouse=True)
def own_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda *a: spark)


def fastq(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    opened = gzip.open if path.suffix == ".gz" else open
    with opened(path, "wt") as out:
        for name, sequence, quality in records:
            out.write(f"@{name}\n{sequence}\n+\n{quality}\n")


def test_generate_and_rewind(spark, tmp_path):
    sheet = tmp_path / "SampleSheet.csv"
    sheet.write_text(SHEET.format(r1=31))
    run = tmp_path / "runs"
    run.mkdir()
    assert cli.main(["generate", "--sample-sheet", str(sheet), "--output", str(run), "--format", "fastq", "--seq-number", "15", "--flowcell-id", "FC", "--random-seed", "4"]) == 0
    found = sorted(str(p.relative_to(run)) for p in run.rglob("*.fastq.gz"))
    assert found == ["FC/Demultiplexing/" + x for x in (
        "P/Sample_a/a_S1_L001_R1_001.fastq.gz", "P/Sample_a/a_S1_L001_R2_001.fastq.gz", "P/Sample_b/b_S2_L001_R1_001.fastq.gz", "P/Sample_b/b_S2_L001_R2_001.fastq.gz", "Q/Sample_c/c_S3_L002_R1_001.fastq.gz")]
    again = tmp_path / "again"
    again.mkdir()
    cli.main(["generate", "--sample-sheet", str(sheet), "--output", str(again), "--format", "fastq", "--seq-number", "15", "--flowcell-id", "FC", "--random-seed", "4"])
    assert all(gzip.decompress((run / f).read_bytes()) == gzip.decompress((again / f).read_bytes()) for f in found)

    rng = random.Random(1)
    for path in run.rglob("*.fastq.gz"):  # qualities of all bins, some reads cut short
        lines = gzip.decompress(path.read_bytes()).decode().split("\n")[:-1]
        fastq(path, [(n[1:], s, "".join(rng.choice("!*9I") for _ in s)) for n, s in zip(lines[0::4], lines[1::4])])
    out = tmp_path / "out"
    assert cli.main(["rewind", "--input-path", str(run / "FC"), "--output-path", str(out), "--total-cycles", "90"]) == 0
    with pytest.raises(FileExistsError):
        cli.main(["rewind", "--input-path", str(run / "FC"), "--output-path", str(out)])
    assert cli.main(["rewind", "--input-path", str(run / "FC"), "--output-path", str(out), "--total-cycles", "90", "--force"]) == 0
    from lanewise.operators import rewind

    some = spark.createDataFrame([(1, 1101, 1000, 1000), (1, 2216, 1000, 1300), (2, 1101, 1000, 1000)], "lane int, tile int, x int, y int")
    files.write_blobs(rewind.filter_files(rewind.occupied(some), [1, 2], [1101, 2216], controls=True), str(tmp_path / "c"))
    kept = {p.name: p.read_bytes() for p in (tmp_path / "c").rglob("s_*")}
    assert {n for n in kept if n.endswith("control")} == {f"s_{lane}_{tile}.control" for lane in (1, 2) for tile in (1101, 2216)}
    assert all(b == encode.control_bytes(2) for n, b in kept.items() if n.endswith("control"))
    assert {n: list(b[12:]) for n, b in kept.items() if n.endswith("filter")} == {"s_1_1101.filter": [1, 0], "s_1_2216.filter": [0, 1], "s_2_1101.filter": [1, 0], "s_2_2216.filter": [0, 0]}
    assert len(list(out.rglob("C*.1"))) == 2 * 90 and (out / "SampleSheet.csv").read_text() == sheet.read_text()

    # read back: positions, filters and calls together give the clusters
    places = encode.read_positions((out / "Data/Intensities/s.locs").read_bytes())
    assert struct.unpack_from("<IfI", (out / "Data/Intensities/s.locs").read_bytes()) == (1, 1.0, len(places))
    assert places == sorted(places, key=lambda p: (p[1], p[0]))
    passed = {p.name: encode.read_filter(p.read_bytes()) for p in out.rglob("*.filter")}
    assert len(passed) == 2 * 128 and all(len(x) == len(places) for x in passed.values())
    calls = {}
    for lane in (1, 2):
        for surface in (1, 2):
            for cycle in range(1, 91):
                path = out / f"Data/Intensities/BaseCalls/L00{lane}/C{cycle}.1/L00{lane}_{surface}.cbcl"
                if path.exists():
                    for tile, (n, block) in encode.read_cbcl(path.read_bytes()).items():
                        calls.setdefault((lane, tile), []).append(encode.unpack(block, n))
    got = set()
    for (lane, tile), cycles in calls.items():
        at = [p for p, ok in zip(places, passed[f"s_{lane}_{tile}.filter"]) if ok]
        assert len(at) == 15 and len(cycles) == 90
        for i, (x, y) in enumerate(at):
            got.add((lane, tile, round(x * 10 + 1000) - 1, round(y * 10 + 1000) - 1, "".join(c[i][0] for c in cycles), tuple(c[i][1] for c in cycles)))
    want = set()
    for r1 in sorted(run.rglob("*_R1_001.fastq.gz")):
        one = list(files.fastq_records(str(r1)))
        r2 = r1.with_name(r1.name.replace("_R1_", "_R2_"))
        two = list(files.fastq_records(str(r2))) if r2.exists() else [None] * len(one)
        for a, b in zip(one, two):
            parts = a[0].split(" ")[0].split(":")
            lane, tile, x, y = map(int, parts[3:7])
            index = a[0].split(":")[-1].split("+")
            umi = (parts[7].split("+") if len(parts) > 7 else []) + ["", ""]
            before = "N" if r1.name.startswith("b") else ""
            mid = "".join(i + "NN" for i in index)
            s = before + umi[0] + a[1] + mid + (umi[1] + b[1] if b else "")
            q = "I" * len(before + umi[0]) + a[2] + "I" * len(mid) + ("I" * len(umi[1]) + b[2] if b else "")
            s, q = s.ljust(90, "N"), q.ljust(90, "!")
            want.add((lane, tile, x, y, s.replace("N", "A"), tuple(ord(c) - 33 for c in q)))
    assert got == want
    xml = (out / "RunInfo.xml").read_text()
    assert 'NumCycles="31"' in xml and 'IsIndexedRead="Y"' in xml and "<Tile>1_" in xml and "FourDigit" in xml


def test_generate_from_a_sheet_of_the_first_version(spark, tmp_path):
    sheet = tmp_path / "SampleSheet.csv"
    sheet.write_text("[Header]\n[Data]\nFCID,Lane,Sample_ID,Sample_Project,Recipe\nHXX1,1,Sample_a,P,30-8-20\nHXX1,2,Sample_b,P,30-8-20\n")
    (tmp_path / "o").mkdir()
    cli.main(["generate", "--sample-sheet", str(sheet), "--output", str(tmp_path / "o"), "--format", "fastq", "--seq-number", "5", "--flowcell-id", "FC"])
    found = sorted(str(p.relative_to(tmp_path / "o/FC/Demultiplexing")) for p in tmp_path.rglob("*.fastq.gz"))
    assert found == ["P/Sample_a/a_S1_L001_R1_001.fastq.gz", "P/Sample_b/b_S2_L002_R1_001.fastq.gz"]
    records = list(files.fastq_records(str(next(tmp_path.rglob("a_S1*")))))
    assert len(records) == 5 and all(n.split(":")[2] == "HXX1" and len(s) == 20 for n, s, _ in records)
    sheet.write_text(sheet.read_text().replace("HXX1,2", "HXX2,2"))
    with pytest.raises(ValueError, match="several flowcells"):
        cli.main(["generate", "--sample-sheet", str(sheet), "--output", str(tmp_path / "o"), "--format", "fastq", "--flowcell-id", "FD"])


def test_tainted_run(spark, tmp_path):
    sheet = tmp_path / "SampleSheet.csv"
    sheet.write_text(SHEET.format(r1=31))
    (tmp_path / "o").mkdir()
    cli.main(["generate", "--sample-sheet", str(sheet), "--output", str(tmp_path / "o"), "--format", "fastq", "--seq-number", "200", "--flowcell-id", "FC", "--taint"])
    one, two = (list(files.fastq_records(str(tmp_path / f"o/FC/Demultiplexing/Undetermined_S0_L001_R{m}_001.fastq.gz"))) for m in (1, 2))
    assert 20 < len(one) < 70 and [x[0].split(" ")[0] for x in one] == [x[0].split(" ")[0] for x in two]
    own = {x for p in (tmp_path / "o").rglob("[ab]_*_R1_*") for x in files.fastq_records(str(p))}
    assert set(one) < own
    out = tmp_path / "r"
    assert cli.main(["mixing", "--input-path", str(tmp_path / "o/FC"), "--output-path", str(tmp_path)]) == 0 and not out.exists()


def test_mixing_tool(tmp_path):
    flow = tmp_path / "FLOW"
    name = "i:1:f:{}:1101:1:1 1:N:0:{}"
    fastq(flow / "sub/Undetermined_S0_L002_R1_001.fastq.gz", [(name.format(2, b), s, q) for b, s, q in (("GAACTGAG+TCGTGGAG", "ACGT", "####"), ("GAACTGAA+TCGTGGAG", "TTTT", "@@@@"), ("CCCCCCCC+GGGGGGGG", "AAAA", "@@@@"), ("GAACTGAA+TCGTGGAG", "TTTT", "@@@@"))])
    (flow / "SampleSheet.csv").write_text(SHEET.format(r1=31).replace("Sample_ID", "X"))
    assert cli.main(["mixing", "--input-path", str(flow), "--output-path", str(tmp_path)]) == 0
    rows = list(csv.DictReader((tmp_path / "FLOW_unexpected_indexes.csv").open()))
    assert [(r["Undetermined_Index"], r["Count"], r["Lane_Project"]) for r in rows] == [("GAACTGAA+TCGTGGAG", "2", "L001"), ("GAACTGAG+TCGTGGAG", "1", "L001")]
    assert (tmp_path / "FLOW_lane_summary.csv").read_text().splitlines()[1] == "L002,3,0.75"
    with pytest.raises(NotADirectoryError):
        cli.main(["mixing", "--input-path", str(tmp_path / "FLOW/sub/none"), "--output-path", str(tmp_path)])


def test_search_and_n_tools(tmp_path, capsys):
    path = tmp_path / "a.fastq.gz"
    fastq(path, [(f"i:1:f:1:1101:{i}:1", s, "I" * len(s)) for i, s in enumerate(["AACGTA", "ACGGNN", "TTTTTT", ""])])
    assert cli.main(["search", "--input", str(path), "--output", str(tmp_path / "s"), "--index-regex", "acgt", "--distance", "1"]) == 0
    assert (tmp_path / "s/pattern1_matches.txt").read_text().splitlines() == ["0 ACGT 1 25.00%", "1 ACGG 1 25.00%"]
    assert (tmp_path / "s/pattern1_errors.txt").read_text().splitlines() == ["0 1 25.00%", "1 1 25.00%"]
    (tmp_path / "p.txt").write_text("CCCCCC\n\nttt\n")
    assert cli.main(["search", "--input", str(path), "--index-file", str(tmp_path / "p.txt")]) == 0
    assert "0 TTT 1 25.00%" in capsys.readouterr().out
    assert cli.main(["ncontent", "--input", str(path), "--output", str(tmp_path / "n")]) == 0
    chart = json.loads((tmp_path / "n/a_n_counts.json").read_text())
    assert chart["data"]["values"] == [{"n_count": 2, "n_sequences": 1}]
    pictures = [ElementTree.fromstring((tmp_path / f"n/a_{w}.svg").read_text()) for w in ("n_counts", "n_per_cycle")]
    assert [len(p.findall("{*}rect")) for p in pictures] == [1, 0] and len(pictures[1].findall("{*}polyline")) == 1
    with pytest.raises(FileNotFoundError):
        cli.main(["search", "--input", str(tmp_path / "none"), "--index-regex", "A"])


@pytest.mark.parametrize(("kind", "lines"), [("fasta", 2), ("fastq", 4), ("fastq-ext", 4), ("text", 1)])
def test_generated_files(tmp_path, kind, lines):
    out = tmp_path / "o"
    out.mkdir()
    assert cli.main(["generate", "--seq-number", "60", "--seq-length", "3", "--output", str(out), "--format", kind, "--random-seed", "1"]) == 0
    (path,) = out.iterdir()
    text = path.read_text().splitlines()
    assert len(text) == 60 * lines
    first = 0 if kind == "text" else 1
    assert len(set(text[first::lines])) == 60
    with pytest.raises(ValueError, match="only 64"):
        cli.main(["generate", "--seq-number", "65", "--seq-length", "3", "--output", str(out)])


@pytest.mark.parametrize("options", [["--alphabet", "A1"], ["--seq-length", "0"], ["--seq-number", "0"], ["--index1", "A1"], ["--seq-mask", "Y1;I1;I1;Y1;Y1"], ["--seq-mask", "Y5;I4", "--index1", "ACG"], ["--sample-sheet", "/none"], ["--output", "/none/x"]])
def test_generate_refuses(options):
    with pytest.raises((cli.argparse.ArgumentTypeError, ValueError)):
        cli.main(["generate", *options])


def test_tree_round_trip(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/file.txt").write_text("x")
    (tmp_path / "a/.hidden").write_text("x")
    listing = tmp_path / "list.txt"
    assert cli.main(["tree", "extract", "--source-path", str(tmp_path / "a"), "--output-file", str(listing)]) == 0
    assert listing.read_text().splitlines() == ["a\tdir", "a/.hidden\tfile", "a/file.txt\tfile", "a/b\tdir"]
    copy = tmp_path / "copy"
    copy.mkdir()
    assert cli.main(["tree", "create", "--source-file", str(listing), "--output-path", str(copy)]) == 0
    assert (copy / "a/b").is_dir() and (copy / "a/file.txt").is_file()
    (copy / "a/file.txt").write_text("kept")
    cli.main(["tree", "create", "--source-file", str(listing), "--output-path", str(copy)])
    assert (copy / "a/file.txt").read_text() == "kept"
    tree.clean(str(copy))
    assert not copy.exists()


def test_files_round_trip(spark, tmp_path):
    rows = [("x/a.fastq.gz", i, f"n{i}", "ACGT", "@II@") for i in range(30)] + [("b.fastq", 0, "m", "", "")]
    df = spark.createDataFrame(rows, "file string, pos long, name string, sequence string, quality string").repartition(5)
    files.write_sequences(df, str(tmp_path / "o"))
    got = files.read_sequences(spark, str(tmp_path / "o"), "*.fastq*").collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(r[1:] for r in rows)
    assert not list(tmp_path.rglob("_temporary*"))
    fasta = tmp_path / "x.fa"
    fasta.write_text(">a b\nAC\nGT\n\n>c\n>d\nA")
    assert [tuple(r)[1:] for r in files.read_sequences(spark, str(fasta)).collect()] == [(0, "a b", "ACGT", None), (1, "c", "", None), (2, "d", "A", None)]
    broken = tmp_path / "y.fastq"
    broken.write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="isn't FASTQ"):
        files.read_sequences(spark, str(broken)).collect()


def blocked(data, size):
    """Gzip members that name their size, and the empty one that ends the file."""
    out = b""
    for at in [*range(0, len(data), size), None]:
        body = zlib.compress(b"" if at is None else data[at : at + size], wbits=-15)
        raw = b"" if at is None else data[at : at + size]
        out += struct.pack("<4BI2BH2s2H", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(raw), len(raw))
    return out


@pytest.mark.parametrize("split", [64, 701])
def test_files_read_in_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    records = [(f"r{i} @+", s := "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))), "".join(rng.choice("@+I") for _ in s)) for i in range(60)]
    text = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records)
    (tmp_path / "a.fastq").write_text(text[:-1])
    (tmp_path / "b.fastq").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "c.fastq.gz").write_bytes(blocked(text.encode(), 91))
    (tmp_path / "d.fastq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "e.fastq").write_text("")
    assert gzip.decompress((tmp_path / "c.fastq.gz").read_bytes()).decode() == text
    got = files.read_sequences(spark, str(tmp_path), "*.fastq*", split)
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted((i, *r) for i, r in enumerate(records) for _ in range(4))
    assert got.select("file").distinct().count() == 4


def test_packed_bytes():
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 8):
        reads = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 6))) for _ in range(n)]
        marks = ["".join(rng.choice("!*9I#") for _ in r) for r in reads]
        if not n:
            continue
        plain = encode.cycle_bytes(reads, marks, 6)
        for c in range(6):
            want = [("ACGT"["ACGT".find(r[c])] if c < len(r) and r[c] != "N" else "A", {"*": 9, "9": 24, "I": 40}.get(m[c], 0) if c < len(m) else 0) for r, m in zip(reads, marks)]
            assert encode.unpack(plain[c].tobytes(), n) == want
    with pytest.raises(ValueError):
        encode.cycle_bytes(["ACGT"], ["IIII"], 3)
    assert encode.control_bytes(2) == struct.pack("<III", 0, 3, 2) + bytes(4)


def test_unknown_options_show_the_usage(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["search", "--input", "x"])
    assert e.value.code == 2 and "usage" in capsys.readouterr().err
