"""Importance resampling against plain Python, and its odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from curvemill.llm import importance as I

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def bucket(f, buckets):
    return zlib.crc32(f.encode()) % buckets


def brute(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, buckets) for f in features(text, longest)[1])
    for text in target:
        t.update(bucket(f, buckets) for f in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for doc, text in rows:
        words, found = features(text, longest)
        weight = sum(gain(bucket(f, buckets)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ready = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = Counter()
    ranks = {}
    for i, r in enumerate(ready[: percent * len(ready) // 100]):
        ranks[(r, place[r])] = i + 1
        place[r] += 1
    seen, final = Counter(), []
    for r in out:
        final.append((r[0], *r[2:], ranks.get((r, seen[r]))))
        seen[r] += 1
    return sorted(map(str, final))


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Äpfel", "ÄPFEL", "naïve", "x y", "İ", "don't", "A1", "\U0001f600", "a\x7fb"]
    text = lambda: r.choice([" ", "\n", ", "]).join(r.choice(words) for _ in range(r.randrange(60)))
    rows = [(r.choice([i, i, i, None, 3]), r.choice([text(), text(), text(), text(), None, "", "!!"])) for i in range(n)]
    return rows + [(900, "same text " * 15)] * 12, [text() for _ in range(10)] + [None, ""]


def frames(spark, rows, target):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")


def have(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize("hot", [20, 500_000])
def test_brute_force(spark, monkeypatch, hot):
    """Whichever strings count as frequent."""
    monkeypatch.setattr(I, "HOT", hot)
    rows, target = corpus(300, 1)
    assert have(I.importance(*frames(spark, rows, target))) == brute(rows, target)


def test_longer_runs_few_buckets_small_pieces(spark, monkeypatch):
    rows, target = corpus(120, 2)
    assert have(I.importance(*frames(spark, rows, target), longest=3, buckets=50, percent=33, least=5, seed=7)) == brute(rows, target, 3, 50, 33, 5, 7)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_pieces(monkeypatch, longest):
    text = " ".join(random.Random(4).choices("a b cc ddd Eé f,g".split(), k=400))
    want = Counter(f.encode() for f in features(text, longest)[1])
    for piece in (1, 3, 17, 1 << 20):
        monkeypatch.setattr(I, "PIECE", piece)
        n, found = I.count_features(text.encode(), longest)
        assert found == want and n == len(features(text, 1)[0])


def test_empty_tables_and_odd_columns(spark):
    rows, target = corpus(40, 3)
    docs, aim = frames(spark, rows, target)
    assert I.importance(docs.limit(0), aim).collect() == []
    assert have(I.importance(docs, aim.limit(0))) == brute(rows, [])
    odd = docs.selectExpr("doc_id", "text", "1 as row", "2 as doc", "'x' as `a.b`", "3 as n_words", "4 as rank")
    assert have(I.importance(odd, aim)) == brute(rows, target)
    drawn = I.resampled(odd, aim, percent=30)
    assert drawn.columns == odd.columns
    ids = {r["doc_id"] for r in I.importance(odd, aim, percent=30).where("rank is not null").collect()}
    assert {r["doc_id"] for r in drawn.collect()} == ids and ids


def test_a_very_long_text(spark):
    rows = [(1, "long word " * 400_000), (2, "short text " * 12), *((i, "filler " * 25) for i in range(3, 14))]
    assert have(I.importance(*frames(spark, rows, ["long words"]))) == brute(rows, ["long words"])
