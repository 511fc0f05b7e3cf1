"""Versioned tables, leases, files in pieces, canonical JSON, and the ledger as a stream."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from curvemill.functions.text import canonical_json
from curvemill.sources import leases, tables
from curvemill.streaming import ledger as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(100).select("id", (F.col("id") % 7).cast("string").alias("a.b"))
    assert tables.current(path) is None and tables.read_version(spark, path, df.schema).count() == 0
    first = tables.write_version(df.repartition(4), path)
    assert first["version"] == 1 and first["rows"] == 100 and rows(tables.read_version(spark, path, df.schema)) == rows(df)
    second = tables.write_version(df.where("id > 90"), path)
    assert second["version"] == 2 and rows(tables.read_version(spark, path, df.schema)) == rows(df.where("id > 90"))
    assert rows(tables.read_version(spark, path, df.schema, 1)) == rows(df)
    assert tables.write_version(df.repartition(1).orderBy(F.desc("id")), path)["content"] == first["content"]  # however rows are dealt
    assert tables.write_version(df.limit(0), path)["rows"] == 0 and tables.read_version(spark, path, df.schema).count() == 0


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(40)
    tables.write_version(df, path)

    def fail(batches):
        for batch in batches:
            yield batch
        if batch.column(0)[0].as_py() >= 20:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        tables.write_version(df.repartitionByRange(4, "id").mapInArrow(fail, "id long"), path)
    assert tables.current(path)["version"] == 1 and rows(tables.read_version(spark, path, df.schema)) == rows(df)
    assert tables.sweep(path) == 0  # too young
    time.sleep(1)
    assert tables.sweep(path, 0.5) <= 1 and len(os.listdir(f"{tmp_path}/t/data")) == 1 and len(os.listdir(f"{tmp_path}/t/versions")) == 1
    assert rows(tables.read_version(spark, path, df.schema)) == rows(df)


def test_write_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(10)
    one = tables.write_version(df, path, once=True)
    assert tables.write_version(df.repartition(3), path, once=True) == one
    with pytest.raises(Exception, match="other content"):
        tables.write_version(df.where("id > 3"), path, once=True)
    assert rows(tables.read_version(spark, path, df.schema)) == rows(df) and len(os.listdir(f"{tmp_path}/t/data")) == 1


def test_a_changed_file_is_no_commit(spark, tmp_path):
    writer = tables._Writer({"path": f"{tmp_path}/t"}, False)
    with pytest.raises(ValueError, match="has not said"):
        writer.commit([None])
    with pytest.raises(ValueError, match="not what its task wrote"):
        writer.commit([tables.Written([{"name": "data/x.parquet", "rows": 1, "bytes": 9}], (0, 0))])
    assert tables.current(f"{tmp_path}/t") is None


def test_lease(tmp_path):
    path = f"{tmp_path}/run"
    first = leases.Lease.take(path, 30)
    with pytest.raises(leases.LeaseLost, match="held"):
        leases.Lease.take(path, 30)
    first.renew()
    first.release()
    second = leases.Lease.take(path, 0.3)
    with pytest.raises(leases.LeaseLost, match="passed on"):
        first.check()
    with pytest.raises(leases.LeaseLost):
        first.renew()
    time.sleep(0.4)  # the second holder is dead
    with leases.Lease.take(path, 30) as third:
        assert (second.epoch, third.epoch) == (2, 3)
        with pytest.raises(leases.LeaseLost):
            second.renew()
    assert leases.Lease.take(path, 1).epoch == 4
    assert not leases._create(path, 4) and leases._create(path, 9)


def test_a_late_writer_is_refused(spark, tmp_path):
    run, path, df = f"{tmp_path}/run", f"{tmp_path}/t", spark.range(5)
    old = leases.Lease.take(run, 0.1)
    tables.write_version(df, path, lease=old)
    time.sleep(0.2)
    new = leases.Lease.take(run, 30)
    with pytest.raises(Exception, match="passed on"):
        tables.write_version(df.limit(2), path, lease=old)
    assert tables.current(path)["rows"] == 5
    assert tables.write_version(df.limit(2), path, lease=new)["rows"] == 2


def test_files_in_pieces(spark, tmp_path):
    root = tmp_path / "files"
    assert tables.hashed_files(spark, f"{root}").collect() == []
    data = {"a.bin": b"", "b/c.BIN": os.urandom(1 << 20), "b/d/e.txt": b"x" * 70_000, "ü 1.bin": b"y"}
    for name, content in data.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    want = sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items())
    assert rows(tables.hashed_files(spark, f"file://{root}", piece=4096)) == want
    assert [r[0] for r in rows(tables.hashed_files(spark, f"{root}", (".bin",)))] == ["a.bin", "b/c.BIN", "ü 1.bin"]


def test_names_of_files_stay_off_the_driver(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"d{i % 2}" / "e").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 2}" / "e" / f"{i}.png").write_bytes(b"x")
    (tmp_path / "top.PNG").write_bytes(b"")
    parts = tables._NamesReader({"path": f"{tmp_path}", "suffixes": ".png"}).partitions()
    assert sorted((p.name, p.deep) for p in parts) == [("", False), ("d0", True), ("d1", True)]
    assert rows(tables.listed_files(spark, f"{tmp_path}", (".png",))) == sorted([(f"d{i % 2}/e/{i}.png", 1) for i in range(200)] + [("top.PNG", 0)])


def test_a_file_larger_than_a_batch(spark, tmp_path):
    big = tmp_path / "big" / "zeros"
    big.parent.mkdir()
    with big.open("wb") as f:
        f.truncate((1 << 31) + 5)  # more than a row can hold
    sha = hashlib.sha256()
    for _ in range(1 << 8):
        sha.update(bytes(1 << 23))
    sha.update(bytes(5))
    assert rows(tables.hashed_files(spark, f"{big.parent}")) == [("zeros", (1 << 31) + 5, sha.hexdigest())]


def test_canonical_json(spark):
    texts = ['{"b":1, "a":{"z":[1,{"y":2,"x":null}],"c":"é\\n"}}', "[3, 1, true]", '"s"', "{}", "[]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(canonical_json(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts]
    odd = spark.createDataFrame([("nope",), (None,), ('{"a":1,"a":2}',)], "t string").select(canonical_json(F.col("t")).alias("c"))
    assert [r["c"] for r in odd.collect()] == [None, None, None]
    same = spark.createDataFrame([('{"a": 1.50, "b": [2]}',), ('{"b":[2],"a":1.5}',)], "t string").select(canonical_json(F.col("t"))).distinct()
    assert same.count() == 1


def test_ledger_stream_goes_on_after_a_restart(spark, tmp_path):
    def send(batch):
        spark.createDataFrame(batch, "run string, number long, key string, tokens long, state string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def settle():
        requests = spark.readStream.schema("run string, number long, key string, tokens long, state string").parquet(f"{tmp_path}/in")
        L.settle(requests, 100, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    send([("a", 1, "k", 70, "complete"), ("a", 0, "k", 20, "complete"), ("b", 0, "x", 5, "failed"), ("c", 3, "x", None, "complete")])
    assert settle() == [("a", 0, 0, "allowed"), ("a", 1, 20, "allowed"), ("b", 0, 0, "allowed"), ("c", 3, 0, "allowed")]
    # a new query with the same checkpoint: one request again, one over budget, a key that fails for the second time
    send([("a", 1, "k", 70, "complete"), ("a", 2, "k", 30, "complete"), ("a", 3, "k", 1, "complete"), ("b", 1, "y", 5, "failed"), ("b", 2, "x", 5, "failed"), ("b", 3, "z", 5, "complete")])
    assert settle() == sorted(
        [("a", 0, 0, "allowed"), ("a", 1, 20, "allowed"), ("a", 1, 90, "repeated"), ("a", 2, 90, "allowed"), ("a", 3, 120, "over_budget")]
        + [("b", 0, 0, "allowed"), ("b", 1, 5, "allowed"), ("b", 2, 10, "allowed"), ("b", 3, 15, "stopped"), ("c", 3, 0, "allowed")]
    )


def test_a_run_reads_its_state_once(monkeypatch):
    import pandas as pd

    class State:
        value, reads = None, 0

        def get(self):
            self.reads += 1
            return self.value

        def exists(self):
            self.reads += 1
            return self.value is not None

        def update(self, value):
            self.value = value

    ledger = L._Ledger(50, 2)
    ledger.run = State()
    part = lambda *numbers: pd.DataFrame({"number": numbers, "key": "", "tokens": 30, "state": "complete"})
    got = [ledger.handleInputRows(("a",), iter(frames), None) for frames in ([part(2, 0), part(1)], [part(2, 3)])]
    assert [tuple(r) for frames in got for f in frames for r in f.to_numpy()] == [("a", 0, 0, "allowed"), ("a", 1, 30, "allowed"), ("a", 2, 60, "over_budget"), ("a", 2, 90, "repeated"), ("a", 3, 90, "over_budget")]
    assert ledger.run.reads == 2
