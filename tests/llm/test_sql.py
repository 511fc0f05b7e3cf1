"""The corpus queries that have SQL against it, on whole tables."""

import math

import duckdb
import pytest

from curvemill.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.01"


def rows(frame):
    show = lambda v: "null" if v is None or v != v else str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(None if isinstance(v, float) and math.isnan(v) else v) for v in r) for r in frame)


@pytest.mark.parametrize("name", ["op11_importance", "op12_repair", "op13_mixture"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want)
