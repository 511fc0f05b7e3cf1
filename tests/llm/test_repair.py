"""Conversation repair against exhaustive search and plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from curvemill.llm import repair as R

GRAMMAR = re.compile("(s?(ua)+)?")


def search(codes):
    """Cheapest audit by a best-first search over (row, initials so far reduced to a state); its order of costs and strings is the rule itself."""
    # state: "" nothing, s, u, a
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(codes) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        new = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, new))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if c != "x":
                extra = 5 * c.isupper()
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, new))
                if c.lower() == new or (c.lower() == "s" and state == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, c.lower()))
    raise AssertionError


def test_every_short_signature():
    for n in range(6):
        for codes in itertools.product("suaoxSUAO" if n < 5 else "suaxU", repeat=n):
            assert R.solve("".join(codes)) == search("".join(codes))


def test_audits_give_the_grammar():
    r = random.Random(1)
    for _ in range(300):
        codes = "".join(r.choices("suauauaoxUA", k=r.randrange(1, 200)))
        cost, audit = R.solve(codes)
        assert (cost, audit) == search(codes)
        roles = {"s": b"system", "u": b"user", "a": b"assistant", "o": b"tool"}
        rows = [(roles.get(c.lower(), b"user"), b"t") for c in codes]
        assert GRAMMAR.fullmatch("".join(role[:1].decode() for _, role, _ in R.replayed(audit, rows)))


def test_long_signatures():
    cost, audit = R.solve("ua" * 40_000 + "x")
    assert (cost, audit) == (2, "K" * 80_000 + "D")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def report(conv, rows):
    mark = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), mark(*r[1:])))
    turns = {t for t, *_ in rows if t is not None}
    seen, codes, n = set(), "", dict.fromkeys(R.FAULTS, 0)
    for _, role, text in rows:
        chars = re.findall("[^\x20\x09-\x0d]", text)
        fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            n[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = search(codes)
    left, state, out = iter(rows), "", []
    for e in audit:
        new = "a" if state == "u" else "u"
        if e == "I":
            out.append(("user:" if new == "u" else "assistant:"))
            state = new
            continue
        _, role, text = next(left)
        if e == "R":
            role = "user" if new == "u" else "assistant"
        if e != "D":
            out.append(f"{role}:{text}")
            state = role[:1]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute(rows):
    return sorted((report(c, r) for c, r in damage(rows).items()), key=str)


def have(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", *R.FAULTS, "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        roles = (["system"] if r.random() < 0.3 else []) + ["user", "assistant"] * r.randrange(5)
        for i, role in enumerate(roles):
            role = r.choice([role] * 8 + ["user", None, "tool", "", "Sys", "\U0001f600"])
            text = r.choice([f"Some words {i}.", f"Some words {i}.", "Yes!", "no end", " \n", None, "naïve?", "", "e.g. 3.5!\n", "ends with é"])
            rows.append((conv, r.choice([i, i, i, i, i, i + 7, None]), role, text))
    return rows + [(3, 1, "user", "twice.")] * 3


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1])
def test_brute_force(spark, seed):
    rows = corpus(250, seed)
    assert have(R.structure_repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_supplied_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert have(R.structure_repair(df)) == brute(rows)


def test_frequent_and_rare_signatures_alike(spark, monkeypatch):
    rows = corpus(60, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(R, "FREQUENT", 0)
    assert have(R.structure_repair(df)) == brute(rows)
    monkeypatch.setattr(R, "FREQUENT", 10**9)
    assert have(R.structure_repair(df)) == brute(rows)


def test_empty_all_dropped_one_row_and_odd_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.structure_repair(empty).collect() == []
    rows = [(i, 0, "user", "A.") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as mark", "2 as `a.b`", "3 as audit", "4 as conv", "5 as kind")
    got = have(R.structure_repair(df))
    assert got == brute(rows)
    assert (sum(x[7] == "" and x[6] == 0 for x in got)) > 0  # dropped whole


def test_repaired_rows(spark):
    rows = corpus(80, 6)
    damaged = R.damaged(spark.createDataFrame(rows, SCHEMA))
    found = R.audits(damaged)
    texts = defaultdict(list)
    for r in R.repaired(damaged, found).orderBy("place").collect():
        assert r["place"] == len(texts[r["conv"]])
        texts[r["conv"]].append(f"{r['role']}:{r['text']}")
    want = {x[0]: x[-1] for x in brute(rows)}
    assert all(hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() == h for c, h in want.items())


def test_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(5000)] + [(2, 0, "user", "A question? " * 100_000)]
    assert have(R.structure_repair(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
