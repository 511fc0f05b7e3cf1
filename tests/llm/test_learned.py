"""Toxicity, decontamination and co-training: grammar rules, brute force, and held-out accuracy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.llm import cotrain
from curvemill.llm import decontaminate
from curvemill.llm.decontaminate import THRESHOLD, Index, decontaminated, leaks
from curvemill.llm.shared import components, table
from curvemill.llm.toxicity import NEGATION, PATTERNS, REPORT, TARGET, Grammar, Scanner, compose, learn, lexicon, negation, reported, target, toxicity, without_toxic

DATA = "/root/testdata/sf0.1"


def plain_matches(g, words):
    """The patterns of a clause by direct rules."""
    out, aimed = Counter(), any(w in TARGET for w in words)
    open_verb = None
    for i, w in enumerate(words):
        marks = ("-" if any(x in NEGATION for x in words[max(0, i - 3) : i]) else "") + ("'" if any(x in REPORT for x in words[:i]) else "")
        letter = g.letter(w)[0]
        if letter == "i":
            out["i" + marks + ("+" if aimed else "")] += g.insult(w)
        elif letter == "t":
            open_verb = marks
        elif letter == "g" and open_verb is not None:
            out["T" + open_verb] += 1
            open_verb = None
    return {p: pytest.approx(v) for p, v in out.items()}


def test_the_composed_machine_is_the_rules(seed=5):
    g = Grammar({"idiot": 2.0, "scum": 0.5}, {"vequ": 1.5})
    r = random.Random(seed)
    for _ in range(3000):
        words = [r.choice("idiot scum vequai you them kill hurt not never said wrote plain word other the".split()) for _ in range(r.randrange(9))]
        assert g.clause(words) == plain_matches(g, words), words
    one = compose(negation(), reported())
    assert one.read(list("nior")) == [["o", "i-", "o", "o"]] and one.read(list("rnnt")) == [["o", "o", "o", "t-'"]]
    assert len(target().read(["i", "g"])) == len(target().read(["i", "o"])) == 1


def test_clauses_not_isolated_words():
    g = Grammar({"idiot": 2.0}, {"vequ": 1.5})
    clause = lambda s: g.clause(s.split())
    assert clause("the idiot of it") == {"i": 2.0} and clause("not an idiot") == {"i-": 2.0} and clause("some said idiot") == {"i'": 2.0} and clause("you idiot") == {"i+": 2.0}
    assert clause("vequai") == {"i": 1.5} and clause("vequ") == clause("plain words") == {}
    assert clause("we will hurt you") == {"T": 1.0} and clause("it will hurt") == {} and clause("said to hurt you idiot") == {"T'": 1.0, "i'+": 2.0}
    value = lambda s: g.score(g.evidence([s.split()]))
    assert value("you idiot") > value("the idiot") > value("said idiot") > value("not an idiot") > value("plain")
    s = Scanner(g)
    assert (s.evidence("The IDIOT. Not relevant. videot idiots") == g.evidence([["the", "idiot"]])).all()
    assert not s.evidence(None).any() and not s.evidence("").any() and not s.evidence("\n..!").any()


def test_context_is_learned(spark):
    """The same words are toxic or not by the clause they stand in; held-out rows are told apart by it."""
    r = random.Random(1)
    word = lambda: r.choice("you they are was were is said never not it he of and there".split()) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(4))
    own = lambda: " ".join(word() for _ in range(12))
    forms = ["{o}. you are scum and vermin. {o}", "{o}. you scum. they are vermin. {o}", "{o}. it was said of scum and of vermin. {o}", "{o}. he never was scum, not vermin. {o}"]
    rows = [(i, forms[i % 4].format(o=own())) for i in range(600)] + [(1000 + i, own()) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 600 and i % 4 < 2)) for i, _ in rows], "doc_id long, toxic int")
    g = learn(docs, labels)
    assert all(g.letter(w)[0] == "i" for w in ("scum", "vermin"))
    assert max(g.weights[p] for p in PATTERNS if "-" in p or "'" in p) < min(g.weights["i+"], 2.0)
    got = toxicity(docs, g).where("held_out").join(labels, "doc_id").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.97
    flat = Grammar(g.words, g.beginnings, g.bias, {p: g.weights["i+"] for p in PATTERNS})
    assert ((toxicity(docs, flat).where("held_out").join(labels, "doc_id").toPandas().eval("(predicted == 1) == (toxic == 1)")).mean()) < 0.9


def test_empty_and_clashing_tables(spark):
    docs = spark.createDataFrame([(1, None, "a", "b", 1), (None, "you scum", "a", "b", 2)], "doc_id int, text string, held_out string, score string, predicted int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    g = learn(docs, labels)
    assert [tuple(r)[1:] for r in toxicity(docs, g).orderBy("doc_id").collect()] == [(False, g.score(np.zeros(len(PATTERNS))), 0)] * 2
    assert toxicity(docs.limit(0), learn(docs.limit(0), labels)).collect() == []
    assert without_toxic(docs, g).schema == docs.schema and without_toxic(docs, g).count() == 2
    bad = Grammar({"scum": 9.0}, {})
    assert [r["doc_id"] for r in without_toxic(docs, bad).collect()] == [1]


def test_lexicon_keeps_the_longest_that_carries_the_label():
    counts = {("vequ", False): (100, 0), ("veq", False): (100, 40), ("vequa", False): (50, 0), ("rare", True): (3, 0), ("the", True): (100, 900)}
    assert set(lexicon(counts, 100, 900)) == {("vequ", False)}


def test_toxicity_rows(spark):
    r = random.Random(0)  # texts of their own words: copies would count once
    own = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(8))
    docs = [(i, f"{own()} and the scum of them, you scum, it was" if i % 4 == 0 else f"{own()} and the others of it was fine", "x") for i in range(400)]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "scum " * 20000 + "you scum.", "x"), (3, "repeated", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None)], "doc_id long, toxic int")
    out = toxicity(df, learn(df, labels)).collect()
    assert len(out) == len(docs)
    for r in out:
        if r["doc_id"] < 400 and r["doc_id"] != 3:
            assert r["predicted"] == (r["doc_id"] % 4 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    low = {r["doc_id"]: r["score"] for r in out}
    assert low[1000] == low[1001] < 0.5 < low[1002]
    none = learn(df, labels.limit(0))
    assert {r["predicted"] for r in toxicity(df, none).collect()} == {0}


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = toxicity(docs, learn(docs, labels)).join(labels, "doc_id").where("held_out").select("toxic", "predicted").toPandas()
    hit = ((got.toxic == 1) & (got.predicted == 1)).sum()
    assert hit / got.predicted.sum() > 0.9 and hit / got.toxic.sum() > 0.8


def test_wand_is_exhaustive_search():
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{int(w)}" for w in r.zipf(1.4, 30) % 500) for _ in range(80)]
    index = Index.alone(list(range(80)), texts)
    for _ in range(40):
        q = np.unique(r.choice(len(index.terms), r.integers(1, len(index.terms))))
        score = np.zeros(80)
        for t in q:
            span = slice(index.begin[t], index.begin[t + 1])
            score[index.items[span]] += index.weights[span]
        for least in (0.1, 0.3, THRESHOLD):
            got = dict(index.wand(q, least))
            assert set(got) == {i for i in range(80) if score[i] >= least and abs(score[i] - least) > 1e-9} | {i for i in got if abs(score[i] - least) <= 1e-9}
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_leaks(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(30)) + "? " + " ".join(word() for _ in range(12)) + ".") for i in range(30)]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{noise(r.randrange(200))} {items[i][1]} {noise(r.randrange(200))}" if i < 30 else noise(300), "q") for i in range(60)]
    question = items[3][1].split("?")[0]
    docs += [(100, None, "q"), (101, "", "q"), (102, f"{noise(50)} {question} {noise(50)}", "q"), (103, noise(3000) + " " + items[5][1].upper(), "q"), (1, docs[1][1], "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, question string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, items[7][1])], "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"]) for x in leaks(df, bench).collect())
    assert got == sorted([*((i, i) for i in range(30)), (1, 1), (7, 52), (103, 5)])
    kept = decontaminated(df, bench)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == [*range(30, 60), 100, 101, 102]
    assert leaks(df.limit(0), bench).collect() == [] and leaks(df, bench.limit(0)).collect() == []


def words_of(text):
    return re.findall(r"[^\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", (text or "").lower())


def brute_leaks(docs, items):
    """Every item against every passage of its stride, with plain dictionaries."""
    bags = {}
    for k, (item, text) in enumerate(items):
        cut = max(text.rfind("?", 0, len(text.rstrip()) - 1), text.rstrip().rfind("\n")) + 1
        q, a = words_of(text[:cut]), words_of(text[cut:])
        if not q or not a:
            w = q + a
            q, a = w[: -(-2 * len(w) // 3)], w[-(-2 * len(w) // 3) :]
        if q:
            bags[k] = (item, q, a)
    n, mean = len(bags), np.mean([len(q) + len(a) for _, q, a in bags.values()])
    df = Counter(w for _, q, a in bags.values() for w in {*q, *a})
    out = {}
    for d, text in docs:
        words = words_of(text)
        for k, (item, q, a) in bags.items():
            tf, stride = Counter(q + a), 40
            while stride < len(q + a):
                stride *= 2
            weight = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(q + a) / mean)) for w, c in tf.items()}
            for begin in range(0, max(1, len(words) - stride), stride):
                around = words[begin : begin + 2 * stride]
                score = sum(v for w, v in weight.items() if w in set(around)) / sum(weight.values())
                runs = lambda x, m: [tuple(x[i : i + m]) for i in range(len(x) - m + 1)]
                share = [np.mean([r in set(runs(around, len(r))) for r in runs(p, min(4, len(p)))]) if p else 1.0 for p in (q, a)]
                if score >= 0.6 and min(share) >= 0.5:
                    out[d, item, k] = max(out.get((d, item, k), (0,)), (round(score, 6), round(share[0], 6), round(share[1], 6)))
    return sorted((d, item, *v) for (d, item, _), v in out.items())


@pytest.mark.parametrize("files", [20_000, 1])
def test_leaks_are_those_of_brute_force(spark, monkeypatch, files):
    monkeypatch.setattr(decontaminate, "ITEMS", files)
    monkeypatch.setattr(decontaminate, "HELD", 2)
    r = random.Random(7)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop")
    some = lambda n: " ".join(word() for _ in range(n))
    items = [(i % 12, f"{some(r.randrange(3, 30))}? {some(r.randrange(1, 12))}.") for i in range(14)] + [(50, some(9)), (51, some(900)), (52, "?"), (53, "one")]
    docs = []
    for i in range(40):
        w = items[i % 18][1].split()
        for _ in range(r.choice([0, 0, 1, 3, 6])):
            w[r.randrange(len(w))] = word()
        docs.append((i, f"{some(r.randrange(150))} {' '.join(w)} {some(r.randrange(150))}"))
    q, a = items[1][1].split("?")
    docs += [(90, f"{q} {some(600)} {a}"), (91, None), (92, ""), (93, some(6000) + items[0][1])]  # 600 words apart is no leak, however long other items are
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], *(round(x[c], 6) for c in ("score", "question", "answer"))) for x in leaks(df, bench).collect())
    assert got == brute_leaks(docs, items) and (90, 1) not in {g[:2] for g in got} and (93, 0) in {g[:2] for g in got}
    assert sorted(x["doc_id"] for x in decontaminated(df, bench).collect()) == sorted({d for d, _ in docs} - {g[0] for g in got})


def test_co_training_beats_the_labels_alone():
    n, known, right = 3000, 40, []
    for seed in range(6):
        r = np.random.default_rng(seed)
        y = (r.random(n) < 0.8).astype(float)
        a, b = (np.c_[y + r.normal(0, 0.3, n), r.normal(0, 1, n)] for _ in "ab")
        lab = np.arange(n) < known
        row = []
        for rounds in (0, cotrain.ROUNDS):
            m = cotrain.co_train((a[lab], b[lab]), y[lab], (a[~lab], b[~lab]), np.arange(known) % 4 == 0, (("p", "q"), ("p", "q")), rounds)
            joint = m.margin(m.text.margin(a[~lab]), m.page.margin(b[~lab]))
            row.append(((joint > 0) == (y[~lab] > 0)).mean())
        right.append(row)
    alone, together = np.mean(right, 0)
    assert together > alone and together > 0.95


def test_every_unlabelled_row_takes_part(spark, monkeypatch):
    """More rows than any sample once held: all are in the pool, and the table's rounds and sums are those of the arrays."""
    r = np.random.default_rng(1)
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("x y. "), (F.col("id") % 37).cast("int"))).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 50).cast("string").alias("source"), F.col("id").alias("n_chars"))
    labels = docs.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 37 > 12).cast("int").alias("quality"))
    seen, whole = [], cotrain.co_train
    monkeypatch.setattr(cotrain, "co_train", lambda *a, **k: seen.append(a) or whole(*a, **k))
    model = cotrain.train(docs, labels)
    pool = seen[0][2]
    assert pool.n == n - 200
    rows = pool.rows.toPandas()
    arrays = cotrain.Rows((np.stack(rows["a"]), np.stack(rows["b"])))
    arrays.u = rows["u"].to_numpy()
    same = whole(*seen[0][:2], arrays, *seen[0][3:])
    for a, b in ((model.text, same.text), (model.page, same.page)):
        assert np.allclose([*a.weights, a.bias], [*b.weights, b.bias], atol=1e-4)
    # each view hands on at most its share of all rows a round, and none that it is unsure of
    handed = [(g >= 0).sum() for g in arrays.given]
    assert 0 < max(handed) <= cotrain.ROUNDS * cotrain.HANDED * pool.n * 1.05
    x = [r.normal(0, 3, (1000, 1)) for _ in "ab"]
    w = [np.array([1.0, 0.0])] * 2
    u = r.random(1000)
    counts = {k: c for (v, k), c in cotrain._counted(x, u, [], w).items() if v == 0 and k < 0}
    past = cotrain.Round(tuple(w), (cotrain._cut(counts, 100, 1),) * 2, ((10**6, 0.0),) * 2)
    to = cotrain._given(x, u, [past])[1]
    assert abs((to == 0).sum() - 100) <= max(counts.values()) and x[0][to == 0].max() <= np.sort(x[0][:, 0])[100] + cotrain.STEP


def test_views_share_nothing_and_both_count(spark):
    """On the real table, with a third of the labels held out of everything: the figures of README."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = table(cotrain.featured(docs))
    m = cotrain.train_on(rows, labels.where(~out))
    assert not set(m.text.names) & set(m.page.names) and all(c in ("doc_id", "a", "b", "u") for c in rows.columns)
    prior, text, page, both = m.losses
    assert text < prior and page < prior and both <= min(text, page) + 0.01 and min(m.handed) > 0 and min(m.joint[1:]) > 0.2
    got = cotrain.scored(rows, m).join(labels.where(out), "doc_id").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.98 and got.kept[got.quality == 0].mean() < 0.1
    loss = lambda p: -np.log(np.clip(np.where(got.quality == 1, p, 1 - p), 1e-9, 1)).mean()
    print("held out: prior, text, page, both", loss(np.full(len(got), got.quality.mean())), loss(got.text_score), loss(got.page_score), loss(got.score), m)
    assert loss(got.score) <= loss(got.text_score) + 0.01 and loss(got.page_score) < loss(np.full(len(got), got.quality.mean()))


def test_exchange_helps_the_weak_view_on_the_real_table(spark):
    """With 200 labels: what the text view hands over makes the metadata view rank held-out rows better, and the joint decisions stay right."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = cotrain.featured(docs).join(labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")), "doc_id", "left").toPandas()
    views, y = (np.stack(rows["a"]), np.stack(rows["b"])), rows["y"].to_numpy()

    def rank(score, good):  # share of (good, bad) pairs in the right order
        order = np.argsort(np.argsort(score))
        n = good.sum()
        return (order[good].sum() - n * (n - 1) / 2) / (n * (len(good) - n))

    got = []
    for seed in range(4):
        lab = np.zeros(len(y), bool)
        lab[np.random.default_rng(seed).choice(np.flatnonzero(~np.isnan(y)), 200, False)] = True
        rest = ~lab & ~np.isnan(y)
        for rounds in (0, cotrain.ROUNDS):
            pool = cotrain.Rows(tuple(v[~lab] for v in views))
            pool.u = rows["u"].to_numpy()[~lab]
            m = cotrain.co_train(tuple(v[lab] for v in views), y[lab], pool, np.arange(200) % 4 == 0, tuple(("f",) * v.shape[1] for v in views), rounds)
            text, page = m.text.margin(views[0][rest]), m.page.margin(views[1][rest])
            got.append((rank(page, y[rest] == 1), ((m.margin(text, page) > 0) == (y[rest] == 1)).mean()))
    alone, together = np.mean(got[::2], 0), np.mean(got[1::2], 0)
    print("metadata view's ranking and joint decisions, without and with the exchange", alone, together)
    assert together[0] > alone[0] + 0.01 and together[1] > 0.98


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = cotrain.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None, "z", 1.0, 2), (2, "", "xx", "h", 0, "z", 1.0, 2), (2, "a " * 50000, "en", "h", 1, "z", 1.0, 2), (None, "x", None, None, 1, "z", None, None)], "doc_id long, text string, lang string, source string, n_chars long, score string, y double, _id int")
    rows = cotrain.quality(odd, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert cotrain.train(odd, labels.limit(0)) is None and {r["kept"] for r in cotrain.quality(odd, None).collect()} == {True}
    few = spark.createDataFrame([(1, 0, 5), (2, 1, 5)], "doc_id long, quality int, y int")
    assert cotrain.quality(odd, cotrain.train(odd, few)).count() == 4
    assert cotrain.train(odd.limit(0), few) is None and cotrain.quality(odd.limit(0), model).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 9), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and got[5] == got[3] == got[9] == 3
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
