"""The pipeline's stages, each on what its predecessor kept, against plain Python or the operators' own results."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from curvemill.llm.queries import oracle_sql, queries
from curvemill.llm.toxicity import learn, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in P.STAGES:
        docs = stage(spark, docs, DATA)
        out.append(docs.toPandas())
        docs = spark.createDataFrame(out[-1])
    return out


def test_columns_and_names(spark, kept):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    assert all(list(k.columns) == list(kept[0].columns) for k in kept[:-1])
    assert all(k.doc_id.is_unique for k in kept)


def test_toxic_documents_go(spark, kept):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = toxicity(docs, learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).toPandas()
    assert set(kept[1].doc_id) == set(scored.doc_id[scored.predicted == 0])


def test_lines_keep_documents(kept):
    assert set(kept[2].doc_id) == set(kept[1].doc_id)
    both = kept[1].merge(kept[2], on="doc_id")
    assert all(set(b.split("\n")) <= set(a.split("\n")) for a, b in zip(both.text_x, both.text_y, strict=True))
    assert (kept[2].n_chars == kept[2].text.str.len()).all()


def test_one_of_each_group_stays(kept):
    import re

    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}

    sets = {d: shingles(t) for d, t in zip(kept[2].doc_id, kept[2].text, strict=True)}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(kept[3].doc_id) == {d for d in sets if find(d) == d}


def test_leaks_go_and_others_stay(spark, kept):
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    gone = set(kept[3].doc_id) - set(kept[4].doc_id)
    verbatim = {d for d, t in zip(kept[3].doc_id, kept[3].text, strict=True) if any(i in " ".join(t.split()) for i in items)}
    assert verbatim <= gone and len(gone - verbatim) <= 2


def test_digests(kept):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(zip(kept[4].doc_id, kept[4].text, strict=True))
    assert set(text) == set(kept[5].doc_id)
    for r in kept[5].itertuples():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_run_is_the_stages(spark, kept):
    got = P.run(spark, DATA).toPandas()
    assert set(got.itertuples(index=False, name=None)) == set(kept[5].itertuples(index=False, name=None))
    assert P.ORACLE_SQL is None


ODD = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _leak string, h long, root string, lines string, d string"


def test_rows_keep_their_identity(spark, tmp_path):
    """Nulls, empty texts, repeated rows, one doc_id with two texts and names that helpers might use, through every stage."""
    long = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    item = "which of the rivers of the north is the longest one? it is the quiet one that ends in the lake of pines."
    texts = [(3, long), (5, long), (5, other), (9, "equal rows of a short text"), (9, "equal rows of a short text"), (None, long), (None, None), (6, None), (7, ""), (8, f"{other} {item} {long}"), (8, "an honest text with the number of a leaking one"), (11, "x " * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *"abc"[:2], 1, "r", "l", "d") for i, t in texts], ODD)
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    want = [(3, long), (5, other), (9, "equal rows of a short text"), (None, None), (6, None), (7, ""), (8, texts[9][1]), (8, texts[10][1]), (11, texts[11][1])]
    kept = docs
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, f"{tmp_path}/in")
        assert kept.schema == docs.schema, name
        if name == "ngram_join":
            assert key(kept) == sorted(want, key=str)
    want.remove((8, texts[9][1]))
    assert key(kept) == sorted(want, key=str)
    assert P.run(spark, f"{tmp_path}/in").count() == len(want)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), f"{tmp_path}/in").collect() == [], name


def test_every_operator_has_one_query(spark):
    names = [n.split("_")[0] for n in queries()]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and set(oracle_sql()) <= set(queries())


def test_odd_column_names(spark, tmp_path):
    """Dots, quotes, blanks and names that differ in case or clash with helpers: every stage keeps them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = {"a.b": "1", "back`tick": "2", "a blank ": "3", "c0": "4", "lines": "5", "host": "6", "Größe": "7", "": "8"}
    extra = docs.toDF(*docs.columns)
    for i, value in enumerate(odd.values()):
        extra = extra.selectExpr("*", f"'{value}' as x{i}")
    extra = extra.toDF(*docs.columns, *odd)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    plain, wide = docs, extra
    for name, stage in P.STAGES[:-1]:
        plain, wide = stage(spark, plain, DATA), stage(spark, wide, str(tmp_path))
        assert wide.columns == [*docs.columns, *odd], name
        plain, wide = (spark.createDataFrame(x.collect(), x.schema) for x in (plain, wide))
        assert sorted(map(tuple, wide.collect())) == sorted((*r, *odd.values()) for r in map(tuple, plain.collect())), name
    last = P.STAGES[-1][1]
    assert sorted(map(tuple, last(spark, wide, str(tmp_path)).collect())) == sorted(map(tuple, last(spark, plain, DATA).collect()))
