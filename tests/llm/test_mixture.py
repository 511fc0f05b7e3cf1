"""The mix of sources against plain Python, and its odd inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from curvemill.llm import mixture as M
from curvemill.llm.shared import by_key, ranked, table


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def place(doc, text, seed=2024):
    return int(hashlib.md5(f"{seed}:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:15], 16)


def fill(sizes, weights, share, epochs):
    """Targets of sources (name -> words), each round by itself."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > epochs * sizes[s]}
        if not full:
            return target | {s: w[s] * level for s in open_}
        for s in full:
            target[s] = epochs * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def mix(rows, weights=M.WEIGHTS, share=M.SHARE, epochs=M.EPOCHS):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    target = fill(sizes, weights, share, epochs)
    out = []
    for s in sizes:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        gap = most = max(0.0, target[s] - whole * sizes[s])
        groups = defaultdict(list)
        for r in rows:
            if r[1] == s:
                groups[place(r[0], r[2])].append(r)
        missed, more = 0, set()
        for p in sorted(groups):
            n = sum(size(t) for *_, t in groups[p])
            if missed == M.PASSES or not n or size(groups[p][0][2]) > most:
                continue
            if n <= gap:
                gap -= n
                more.add(p)
            else:
                missed, most = missed + 1, gap
        out += [(d, size(t), sizes[s], round(target[s], 6), size(t) * (whole + (p in more))) for p, g in groups.items() for d, _, t in g]
    return Counter(out)


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["a", "a", "a", "b", "c", "Z", "é", "\U00010000", "", None, "d"])
        text = r.choice([None, "", " \n\t", "one", *[" ".join("w" for _ in range(r.randrange(1, 60)))] * 9, "x " * r.randrange(2000)])
        rows.append((r.choice([i, i, i, None, 7]), source, text))
    return rows + [(5, "a", "same words twice")] * 3 + [(9, "empty source only", "")]


def got(df):
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1])
def test_brute_force(spark, seed):
    rows = corpus(400, seed)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert got(M.mixture(df)) == mix(rows)


def test_other_parameters(spark):
    rows = corpus(150, 5)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert got(M.mixture(df, weights=(1, 9), share=0.7, epochs=3)) == mix(rows, (1, 9), 0.7, 3)
    assert got(M.mixture(df, share=5.0)) == mix(rows, share=5.0)  # every source is clamped


def test_near_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = M.mixture(docs)
    sums = out.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("n")).collect()
    assert all(0 <= r["target"] - r["taken"] <= 0.01 * r["n"] and r["target"] <= 2 * r["n"] for r in sums)
    assert out.where("taken > 2 * size").count() == 0
    assert got(out) == got(M.mixture(docs.repartition(7)))


def test_copies_with_odd_columns(spark):
    rows = corpus(120, 3)
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], "doc_id long, source string, text string, `a.b` string, copies int, `size``_` int")
    out = M.mixed(df)
    assert out.columns == [*df.columns, "copy"]
    words = defaultdict(int)
    for r in out.collect():
        words[(r["doc_id"], r["source"], r["text"])] += size(r["text"])
    taken = got(M.mixture(df))
    assert sum(words.values()) == sum(k[4] * n for k, n in taken.items())
    assert max(Counter((r["doc_id"], r["source"], r["text"], r["copy"]) for r in out.where("doc_id <> 5 and doc_id <> 7").collect()).values()) == 1


def test_empty_and_one(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mixture(empty).collect() == [] and M.mixed(empty).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in M.mixture(one).collect()] == [(1, 0, 0, 0.0, 0)]


def test_many_sources_take_the_salted_join(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 7).cast("string")).alias("source"))
    keyed = table(rows.groupBy("source").agg(F.count("*").alias("n")))
    a = by_key(rows, keyed, "source", F.col("id"))
    b = by_key(rows, keyed, "source", F.col("id"), limit=2)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() == 300


def test_ranks(spark):
    rows = table(spark.createDataFrame([(v,) for v in [3, 1, 2, 2, 2, None, 9, 1]], "v int"))
    have = [(r["v"], r["rank"]) for r in ranked(rows, F.asc_nulls_last("v")).orderBy("rank").collect()]
    assert have == list(zip([1, 1, 2, 2, 2, 3, 9, None], range(1, 9), strict=True))


def test_plan_holds_no_python(spark):
    df = spark.createDataFrame(corpus(20, 1), "doc_id long, source string, text string")
    plan = M.mixture(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
