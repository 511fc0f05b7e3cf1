"""Every registered query of the curve operators against its SQL in DuckDB; queries without SQL must give rows."""

import duckdb
import numpy as np
import pytest

from curvemill.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    return sorted(tuple(str(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    got = Q.queries()[name](spark, DATA).toPandas()
    if sql := Q.oracle_sql().get(name):
        assert rows(got) == rows(db.execute(sql).df())
    else:
        assert len(got)


def test_neighbors_of_whole_embeddings(spark, db):
    e = db.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").df()
    x = np.stack(e["embedding"]).astype(float)
    dev = x.std(0)
    x = x / np.where(dev < 1e-12, 1.0, dev)
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    ids = e["vec_id"].to_numpy()
    want = sorted((int(q), int(ids[j]), i + 1) for q, row in zip(ids, far, strict=True) for i, j in enumerate(np.argsort(row, kind="stable")[:3]))
    got = sorted(tuple(r) for r in Q.queries()["knn_neighbors"](spark, DATA).collect())
    assert x.shape[1] == Q.DIMS and got == want


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lookups_prune_columns(spark):
    plan = Q.queries()["curve_build"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.split("\n") if "FileScan" in x and "l_extendedprice" in x)
    assert "l_shipdate" not in line and "l_comment" not in line


def test_command_line(spark, capsys, tmp_path):
    from curvemill.__main__ import main

    assert main(["list"]) == 0 and "curve_loo_emd *" in capsys.readouterr().out
    assert main(["run", "curve_build", "--data", DATA, "--out", str(tmp_path)]) == 0
    assert spark.read.parquet(f"{tmp_path}/curve_build").count() == Q.queries()["curve_build"](spark, DATA).count()
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--data", DATA])
