"""Lines that can't be read: each reason, odd valid lines, broadcast and sort-merge joins of the dictionary."""

import pytest

from lanewise.operators import rejects

NAME = "VQ1:25:HX:3:2309:25985:1743 1:N:0:TG+GT"
CASES = [
    (f"1,{NAME},ACGT,IIII,s", None),
    (f'"1","{NAME}","ACGT","II,I","a ""b"" c"', None),
    (f"2,{NAME.replace(' ', ':ACG+T ')},A,!,", None),
    (f'3,{NAME},ACGT,"I""II","x\ny"', None),
    (f'1,{NAME},ACGT,II"I,s', "quoting"),
    (f'"1,{NAME},ACGT,IIII,s', "quoting"),
    (f'"1"x,{NAME},ACGT,IIII,s', "quoting"),
    (f'1,{NAME},ACGT,"IIII', "quoting"),
    (f"1,{NAME},ACGT,IIII", "columns"),
    (f"1,{NAME},ACGT,IIII,s,", "columns"),
    ("", "columns"),
    (None, "columns"),
    (f" 1,{NAME},ACGT,IIII,s", "value"),
    (f"1,{NAME} ,ACGT,IIII,s", "value"),
    (f"1,{NAME.replace(':3:', ':9:')},ACGT,IIII,s", "value"),
    (f"1,{NAME.replace('2309', '2509')},ACGT,IIII,s", "value"),
    (f"1,{NAME.replace('VQ1', 'V1')},ACGT,IIII,s", "value"),
    ("1,NULL,ACGT,IIII,s", "value"),
    (f"1,{NAME},ACGU,IIII,s", "value"),
    (f"1,{NAME},,,s", "value"),
    (f"1,{NAME},ACGT,III,s", "value"),
    (f"1,{NAME},ACGT,III\x7f,s", "value"),
    (f"1,{NAME}\n,ACGT,IIII,s", "value"),
    (f"x,{NAME},ACGT,IIII,{'y' * 200_000}", "value"),
    (f'1,{NAME},ACGT,IIII,"{chr(34) * 100_000}"', None),
]


@pytest.fixture(params=["10m", "-1"])
def joins(spark, request):
    """The planner's size limit of broadcasts, by default and without any."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reasons(spark, joins):
    df = spark.createDataFrame([(i % 3, line, i, "a", "b") for i, (line, _) in enumerate(CASES)], "raw_id long, line string, n int, reason string, fields string")
    found = rejects.judge(df)
    assert found.columns == ["raw_id", "line", "n", "reason", "fields", "fields_", "reason_", "detail"]
    rows = sorted(found.select("n", "reason_", "detail").collect())
    assert [r[1] for r in rows] == [reason for _, reason in CASES]
    assert all((r[2] is not None) == (r[1] == "value") for r in rows)


def test_empty_table_and_repeated_rows(spark, joins):
    df = spark.createDataFrame([], "raw_id long, line string")
    assert rejects.judge(df).count() == 0
    twice = spark.createDataFrame([(1, "a,b,c,d,e"), (1, "a,b,c,d,e"), (1, CASES[0][0])], "raw_id long, line string")
    assert sorted(str(r[0]) for r in rejects.judge(twice).select("reason").collect()) == ["None", "value", "value"]


def test_values_are_judged_behind_the_exchange(spark):
    df = spark.createDataFrame([(1, CASES[0][0])], "raw_id long, line string")
    rows = rejects.structure(df, "line", "parts", "fields", "reason")
    plan = rejects.value_dictionary(rows, "fields")._jdf.queryExecution().executedPlan().toString()
    assert "[YN]" in plan.split("Exchange")[0] and "[YN]" not in plan.split("Exchange")[1]


def test_typed_rows(spark):
    df = spark.createDataFrame([(7, CASES[1][0]), (8, CASES[2][0]), (9, "x")], "raw_id long, line string")
    rows = sorted(rejects.typed(rejects.judge(df), ["raw_id"]).collect())
    assert [int(r["read_no"]) for r in rows] == [1, 2]
    assert rows[0].asDict() | {"read_no": 1} == {
        "raw_id": 7, "read_no": 1, "name": NAME, "instrument": "VQ1", "run": 25, "flowcell": "HX", "lane": 3, "tile": 2309, "x": 25985, "y": 1743,
        "umi": None, "read": 1, "filtered": "N", "control": 0, "barcode": "TG+GT", "sequence": "ACGT", "quality": "II,I", "sample": 'a "b" c'}
    assert rows[1]["umi"] == "ACG+T" and rows[1]["sample"] == ""
