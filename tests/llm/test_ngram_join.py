"""The join against brute force over all pairs, with small classes so that every path runs."""

import random
import re

import pytest

from curvemill.llm import ngram_join, shared
from curvemill.llm.ngram_join import near_duplicates, one_of_each
from curvemill.llm.shingles import shingle_sets


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 5)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.randrange(1, 90))] for _ in range(12)]
    rows = []
    for i in range(140):
        words = list(r.choice(bases)) if r.random() < 0.8 else [word() for _ in range(r.randrange(60))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            if words:
                words[r.randrange(len(words))] = word().upper()
        if r.random() < 0.3:
            words += passage
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (503, "One"), (504, "one"), (505, "é É"), (506, "É é"), (507, "x " * 9000)]


@pytest.mark.parametrize("frequent, long", [(1, 20), (1, 256), (4, 1), (4, 40), (100, 256)])
def test_brute_force(spark, monkeypatch, frequent, long):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "LONG", long)
    rows = corpus(frequent)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_shuffled_entries_and_wide_classes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared.sized, "__defaults__", (0,))
    monkeypatch.setattr(ngram_join, "PIECE", 100)
    monkeypatch.setattr(ngram_join, "CLASS_ROWS", 5)
    rows = corpus(9)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_empty_repeated_and_extra_columns(spark):
    schema = "doc_id int, text string, component_id string, n long, class string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    row = (7, "a b c d e f", "x", 1, "y")
    got = near_duplicates(spark.createDataFrame([row, row, (9, "A b c d e f", None, None, None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(7, 2, 7), (7, 2, 7), (9, 2, 7)]


def test_null_ids_link_and_rows_of_one_id_stay_apart(spark):
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(words[k : k + 50])
    # 1 and 2 link only through a row without id; 5 names a copy of 1 and a text of its own
    rows = [(1, text(0)), (None, text(5)), (2, text(10)), (5, text(0)), (5, "quite another text that nothing else holds"), (None, "alone"), (9, "x y z"), (9, "x y z")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id int, text string, h int, root string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (5, 1), (5, 5), (None, None), (9, 9), (9, 9)], key=str)
    kept = one_of_each(df)
    assert kept.schema == df.schema
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, text(0)), (5, rows[4][1]), (None, "alone"), (9, "x y z")], key=str)
    assert one_of_each(df.limit(0)).collect() == []


def test_chain_links_through_a_middle_text(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(3, " ".join(words)), (2, " ".join(words[5:])), (1, " ".join(words[10:])), (0, "z " * 30)]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_sets_do_not_depend_on_the_batch():
    texts = [b"a b c d e f g", b"", None, b"A B", b"x" * 5000, "é ü".encode()]
    together = [s.tolist() for s in shingle_sets(texts)]
    assert together == [next(shingle_sets([t])).tolist() for t in texts]
    assert together[1] == together[2] == [] and len(together[0]) == 3


def crowd():
    """Copies of one text that share most of their tokens: with an end of their own, which link; with three words of their own, which don't; with one of seven shared
    words and two of their own, which link with the copy that has the shared word alone, where there is one."""
    r, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        words = list(base)
        if i % 3 == 0:
            words[0] = f"e{i}"
        else:
            words[r.randrange(40, 60)], words[r.randrange(70, 90)] = f"x{i}", f"y{i}"
            words[100 if i % 3 == 1 else 6 * (i % 7) + 1] = f"z{i if i % 3 == 1 else i % 7}"
        rows.append((i, " ".join(words)))
    for k in range(4):
        rows.append((300 + k, " ".join([*base[: 6 * k + 1], f"z{k}", *base[6 * k + 2 :]])))
    return rows


def test_a_crowd_is_dealt_once(spark, monkeypatch):
    for name, value in (("FREQUENT", 8), ("BLOCK", 16), ("TURNS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    dealt, written = [], ngram_join.table

    def table(df):
        out = written(df)
        if "root" in out.columns and out.columns[:2] == ["entry", "class"] and "c" in out.columns:
            dealt.append(out.selectExpr("sum(ceil(c / 16)) AS rows").first()["rows"])
        elif "main" in out.columns:
            dealt.append(out.selectExpr("sum(if(main, ceil(r / 16), ceil(l / 16) + ceil(r / 16))) AS rows").first()["rows"])
        return out

    monkeypatch.setattr(ngram_join, "table", table)
    want = brute(crowd())
    assert 60 < len({c for _, _, c in want}) < 150
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(crowd(), "doc_id long, text string")).collect()} == want
    # by entries and by what is dealt in their place: without that, each entry deals all its classes to all its blocks
    assert len(dealt) == 2 and 0 < 8 * dealt[1] < dealt[0]
