"""Line dedup and quality rules against plain Python."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from curvemill.llm.lines import dedup_lines, quality_rules
from curvemill.llm.queries import oracle_sql, queries

SPACE = "[\x20\x09-\x0d]+"


def norm(line):
    return re.sub(SPACE, " ", line.lower()).strip(" ")


def over(rows, ratio, least):
    pages, seen = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for doc, host, text in rows:
        pages[host or ""].add(doc)
        for x in (text or "").split("\n"):
            if re.search("[^\x20\x09-\x0d]", x):
                seen[host or ""][norm(x)].add(doc)
    return {h: {x for x, d in c.items() if len(d) >= least and len(d) > ratio * len(pages[h])} for h, c in seen.items()}


def corpus():
    r = random.Random(1)
    lines = ["Header  line", "header LINE", " footer\t", "", "é É", "license", *(f"own {i} " + "w " * r.randrange(12) for i in range(60))]
    rows = []
    for i in range(150):
        host = r.choice(["a", "a", "a", "b", None])
        text = "\n".join(r.choice(lines) for _ in range(r.randrange(8)))
        rows.append((i, host, text if r.random() > 0.05 else r.choice([None, "", "x y z " * 40, "\n\n", "#$% a|b <&>"])))
    return rows


def test_dedup(spark):
    rows = corpus()
    gone = over(rows, 0.2, 3)
    df = spark.createDataFrame([(i, h, t, "k") for i, h, t in rows], "doc_id long, source string, text string, host string")
    got = dedup_lines(df, ratio=0.2, least=3)
    assert got.columns == df.columns
    have = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, h, t in rows:
        want = None if t is None else "\n".join(x for x in t.split("\n") if norm(x) not in gone.get(h or "", ()) or not norm(x))
        assert have[i] == want
    assert any(have[i] != t for i, _, t in rows)
    assert dedup_lines(df.limit(0)).collect() == []


def measured(text):
    words = [w for w in re.split(SPACE, text or "") if w]
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_rules(spark):
    rows = corpus() + [(900, "c", ("a b c d e f g h i " * 5 + "\n") * 3), (901, "c", " ".join(map(str, range(4000))) + " 0 1 2 3 4 5 6 7"), (902, "c", "w " * 20), (903, "c", "w " * 7)]
    gone = over(rows, 0.2, 3)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, kept int, n_words int")
    for r in quality_rules(df, ratio=0.2, least=3).collect():
        host, text = next((h, t) for i, h, t in rows if i == r["doc_id"])
        want = measured(text)
        assert tuple(r)[1:6] == want, r["doc_id"]
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        left = sum(len([w for w in re.split(SPACE, x) if w]) for x in (text or "").split("\n") if norm(x) not in gone.get(host or "", ()))
        assert (r["base_failed"], r["kept"], r["words_left"]) == (failed, not failed and left >= 0.5 * want[0], left)
    assert quality_rules(df.limit(0)).collect() == []


def test_repeated_rows_count_once_and_agree_with_the_sql(spark, tmp_path):
    boiler, own = "Shared line of the host", lambda i: f"line {i} of its own with some more words to read here and there and so on till there are twenty of them"
    rows = [(i, f"{boiler}\n{own(i)}", "en", "a", 5) for i in range(4)] + [(4, f"repeated five times\n{own(4)}", "en", "a", 5)] * 5
    rows += [(None, own(50), "en", "a", 5), (None, f"{boiler}\n{own(51)}", None, "a", 5), (7, "x " * 30_000 + "\n" + boiler, "en", "a", 60_000), (8, None, None, None, None), (9, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    clean = lambda frame: Counter(tuple(None if pd.isna(v) else v for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
    for name in ("op6_line_dedup", "op10_quality_rules"):
        got, want = queries()[name](spark, str(tmp_path)).toPandas(), con.execute(oracle_sql()[name]).df()
        assert clean(got) == clean(want), name
    left = [r["text"] for r in dedup_lines(docs).collect() if r["doc_id"] in (1, 4)]
    assert left[0] == own(1) and left[1:] == [f"repeated five times\n{own(4)}"] * 5  # five documents (and one without id) share the first line, one the other


def test_names_that_helpers_like(spark):
    df = spark.createDataFrame([(i, "a\nb", "h", "l", "f", "o", "k", 3) for i in range(6)], "doc_id long, text string, source string, lines string, left string, host string, _host string, n_chars int")
    out = dedup_lines(df)
    assert out.schema == df.schema and {r["text"] for r in out.collect()} == {""} and {r["n_chars"] for r in out.collect()} == {0}
    assert quality_rules(df).count() == 6


def test_plans_hold_no_python(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    for out in (dedup_lines(df), quality_rules(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
