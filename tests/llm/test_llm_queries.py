"""The registered queries against their SQL on the smallest tables; those without SQL give rows of a stable form."""

from pathlib import Path

import duckdb
import pytest

from lanewise.llm import queries, sql

DATA = "/root/testdata/sf0.001"
FORMS = {
    "p3_sample": None, "p3_arrivals": None, "p6_ids": ["doc_id", "ids"], "p7_mixture": ["doc_id", "source", "tokens", "copies"],
    "p7_shares": None, "p8_ratios": ["doc_id", "llr", "candidate", "repetitive"],
}


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = con.execute(sql.oracle_sql()[name])
    names = [c[0] for c in found.description]
    rows = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(tuple, rows.select(names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(FORMS))
def test_other_queries(spark, name):
    rows = queries.queries()[name](spark, DATA)
    assert FORMS[name] in (None, rows.columns) and rows.count() > 0


def test_every_query_is_covered():
    assert set(queries.queries()) == set(FORMS) | set(sql.oracle_sql())
