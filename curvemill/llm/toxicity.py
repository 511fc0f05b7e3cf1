"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause (the words between . ! ? ; : and line feeds), each the output of the one before: the insult transducer
turns words into letters (insult, threat verb, target, negation, report, other) and gives insults their weight; the negation transducer marks
insults and threats in the NEAR words after a negation; the reported-speech transducer marks those after a verb of saying;
the threat transducer turns a target after a threat verb into a threat; the target transducer marks insults of clauses that have a target
anywhere, by taking both guesses and keeping the one that comes true. compose() joins the last four into one machine. Its output is the clause's matches by
pattern (insult or threat; with a target, negated, reported). A clause adds log(1 + weight) to each pattern that matched,
and the score is a logistic of the patterns' sums, with a weight for each pattern: what a word is worth depends on the clause it stands in.

The insult lexicon (whole words and word beginnings), its weights and the weights of the patterns are learned from labelled rows with
crc32(doc_id as text) mod 3 other than 1, at most SAMPLE rows of each label (chosen by a hash of doc_id); counts over
their words are made in Spark and every word that bears evidence enters the lexicon, however many there are. Scores use the text alone.

Null, empty and wordless texts have no match and score the base rate's floor (0.0 to 4 digits); repeated rows score alike; labels of null
count as absent; a doc_id labelled both ways counts as toxic; of a labelled doc_id's different texts the least is learned from. Without
toxic labels only the threat grammar is left. Texts of any length are scored whole; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches, table, tidy
from .shingles import batches, select_rows, shingle_sets

#: Labelled documents of each label that are learned from at most.
SAMPLE = 6_000
#: Toxic documents that an entry of the insult lexicon must be in at least (or a hundredth of them).
SUPPORT = 3
#: Word beginnings of these lengths are looked at besides whole words.
BEGINNINGS = range(3, 9)
#: Least log-odds of an entry, and standard deviations of caution in it.
ODDS, SIGMAS = 1.0, 2.0
THRESHOLD = 0.7
#: Strength of the prior of bias and pattern weights, in rows; a pattern's sum counts up to MOST in learning.
PRIOR, MOST = 2.0, 8.0
#: Counts that a task holds before it hands them on.
HELD = 200_000

# Fixed word lists of the grammar.
TARGET = frozenset("you your yours he him his she her they them their this these those people everyone tu vous toi il elle ils elles du dich dir sie ihr er tú usted ustedes él ella ellos".split())
THREAT = frozenset("kill hurt destroy attack burn shoot stab beat murder tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split())
NEGATION = frozenset("not no never without isn't aren't wasn't don't doesn't nicht kein keine nie ohne pas jamais sans nunca jamás sin".split())
REPORT = frozenset("said says say claimed claims wrote writes quoted called reported alleged dit écrit selon sagte sagt schrieb laut dijo dice escribió según".split())

LISTED = TARGET | THREAT | NEGATION | REPORT

#: Words that a negation reaches, and where the learned weights of patterns start: factors of a target, a negation and reported speech, and a threat's own weight.
NEAR, WITH_TARGET, NEGATED, REPORTED, THREAT_WEIGHT = 3, 1.25, 0.5, 0.7, 1.0
BIAS, SLOPE = -4.0, 2.0

# Letters of the grammar; marks are appended to those that are matched.
INSULT, VERB, TARGETED, NOT, SAID, OTHER = "itgnro"
THREATENED = "T"
AIMED, DENIED, QUOTED = "+", "-", "'"
_MARKED = [x + n + q for x in (INSULT, VERB) for n in ("", DENIED) for q in ("", QUOTED)]
LETTERS = (INSULT, VERB, TARGETED, NOT, SAID, OTHER)
#: What the machine puts out where something matched.
PATTERNS = (*(INSULT + n + q + a for a in ("", AIMED) for n in ("", DENIED) for q in ("", QUOTED)), *(THREATENED + n + q for n in ("", DENIED) for q in ("", QUOTED)))


@dataclass
class Transducer:
    """A machine from letters to letters of the same number: arcs[state][letter] lists (output, next state)."""

    starts: set
    finals: set = field(default_factory=set)
    arcs: dict = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))

    def add(self, state, letter: str, output: str, to) -> None:
        self.arcs[state][letter].append((output, to))

    def read(self, letters: list[str]) -> list[list[str]]:
        """The outputs of all accepting paths."""
        live = [(s, ()) for s in self.starts]
        for x in letters:
            live = [(to, (out, path)) for s, path in live for out, to in self.arcs[s].get(x, ())]
        found = []
        for s, path in live:
            if s in self.finals:
                outputs = []
                while path:
                    out, path = path
                    outputs.append(out)
                found.append(outputs[::-1])
        return found


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that gives what b makes of a's output; states that cannot be reached are left out."""
    out = Transducer({(p, q) for p in a.starts for q in b.starts})
    todo, seen = [*out.starts], set(out.starts)
    while todo:
        p, q = todo.pop()
        if p in a.finals and q in b.finals:
            out.finals.add((p, q))
        for letter, moves in a.arcs[p].items():
            for middle, to_p in moves:
                for output, to_q in b.arcs[q].get(middle, ()):
                    out.add((p, q), letter, output, (to_p, to_q))
                    if (to_p, to_q) not in seen:
                        seen.add((to_p, to_q))
                        todo.append((to_p, to_q))
    return out


def negation() -> Transducer:
    """Marks insults and threat verbs among the NEAR words after a negation; the state is how many are left."""
    t = Transducer({0}, set(range(NEAR + 1)))
    for left in range(NEAR + 1):
        for x in LETTERS:
            t.add(left, x, x + DENIED if left and x in (INSULT, VERB) else OTHER if x == NOT else x, NEAR if x == NOT else max(0, left - 1))
    return t


def reported() -> Transducer:
    """Marks insults and threat verbs after a verb of saying."""
    t = Transducer({False}, {False, True})
    for quoted in (False, True):
        for x in (INSULT, VERB, INSULT + DENIED, VERB + DENIED):
            t.add(quoted, x, x + QUOTED if quoted else x, quoted)
        for x in (TARGETED, OTHER):
            t.add(quoted, x, x, quoted)
        t.add(quoted, SAID, OTHER, True)
    return t


def threat() -> Transducer:
    """Turns the first target after a threat verb into a threat, with the verb's marks; the state is the verb that is open."""
    verbs = [x for x in _MARKED if x[0] == VERB]
    t = Transducer({""}, {"", *verbs})
    for state in t.finals:
        for x in _MARKED:
            t.add(state, x, OTHER if x in verbs else x, x if x in verbs else state)
        t.add(state, OTHER, OTHER, state)
        t.add(state, TARGETED, THREATENED + state[1:] if state else TARGETED, "")
    return t


def target() -> Transducer:
    """Marks the insults of clauses with a target: one path guesses that there is none, one that there is, and only the right one ends well."""
    t = Transducer({"none", "awaited"}, {"none", "met"})
    aims = (TARGETED, *(x for x in PATTERNS if x[0] == THREATENED))
    for state in ("none", "awaited", "met"):
        t.add(state, OTHER, OTHER, state)
        for x in _MARKED:
            if x[0] == INSULT:
                t.add(state, x, x if state == "none" else x + AIMED, state)
        for x in aims if state != "none" else ():
            t.add(state, x, OTHER if x == TARGETED else x, "met")
    return t


_composed: list[Transducer] = []


def machine() -> Transducer:
    """negation, reported speech, threat and target in one, made once a process."""
    if not _composed:
        _composed.append(compose(compose(compose(negation(), reported()), threat()), target()))
    return _composed[0]


def first_weights() -> dict[str, float]:
    """Weights of the patterns before learning."""
    return {p: SLOPE * (THREAT_WEIGHT if p[0] == THREATENED else 1.0) * (WITH_TARGET if AIMED in p else 1.0) * (NEGATED if DENIED in p else 1.0) * (REPORTED if QUOTED in p else 1.0) for p in PATTERNS}


# Words as the pattern lists know them: letters with an apostrophe inside.
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Grammar:
    """words, beginnings: the insult lexicon; weights: what a pattern is worth."""

    words: dict[str, float]
    beginnings: dict[str, float]
    bias: float = BIAS
    weights: dict[str, float] = field(default_factory=first_weights)

    def insult(self, word: str) -> float:
        """Weight of the insult transducer's output for a word; the longest entry that it begins with counts."""
        if (w := self.words.get(word)) is not None:
            return w
        for n in reversed(BEGINNINGS):
            if n < len(word) and (w := self.beginnings.get(word[:n])) is not None:
                return w
        return 0.0

    def letter(self, word: str) -> tuple[str, float]:
        """The insult transducer: a word's letter and weight."""
        for words, letter in ((NEGATION, NOT), (REPORT, SAID), (TARGET, TARGETED), (THREAT, VERB)):
            if word in words:
                return letter, 1.0
        weight = self.insult(word)
        return (INSULT, weight) if weight else (OTHER, 1.0)

    def clause(self, words: list[str]) -> dict[str, float]:
        """The matches of one clause: pattern -> weight."""
        letters = [self.letter(w) for w in words]
        (outputs,) = machine().read([x for x, _ in letters])  # exactly one path is right
        out: dict[str, float] = {}
        for pattern, (_, weight) in zip(outputs, letters, strict=True):
            if pattern != OTHER:
                out[pattern] = out.get(pattern, 0.0) + weight
        return out

    def evidence(self, clauses: list[list[str]]) -> np.ndarray:
        """Sums over the clauses of log(1 + weight), by PATTERNS."""
        out = np.zeros(len(PATTERNS))
        for c in clauses:
            for pattern, weight in self.clause(c).items():
                out[_AT[pattern]] += math.log1p(weight)
        return out

    def score(self, evidence: np.ndarray) -> float:
        x = self.bias + float(evidence @ np.array([self.weights[p] for p in PATTERNS]))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


_AT = {p: i for i, p in enumerate(PATTERNS)}


class Scanner:
    """Finds the clauses that may weigh anything with one automaton; only those go through the grammar."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.tree = ahocorasick.Automaton()
        for x in [*grammar.words, *grammar.beginnings, *THREAT]:
            self.tree.add_word(x, len(x))
        self.tree.make_automaton()

    def evidence(self, text: str | None) -> np.ndarray:
        low = (text or "").lower()
        clauses, done = [], -1
        for end, n in self.tree.iter(low):
            if end < done or (begin := end - n + 1) > 0 and low[begin - 1].isalpha():
                continue
            a = max((low.rfind(c, 0, begin) for c in ".!?;:\n")) + 1
            m = _CLAUSE.search(low, begin)
            done = m.start() if m else len(low)
            clauses.append(_WORD.findall(low[a:done]))
        return self.grammar.evidence(clauses)

    def score(self, text: str | None) -> float:
        return self.grammar.score(self.evidence(text))


def atoms(text: str) -> set[tuple[str, bool]]:
    """(word, True) for the words of a text and (beginning, False) for longer words' beginnings."""
    words = set(_WORD.findall(text.lower()))
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in BEGINNINGS if n < len(w)}


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """With the least shingle hash, which copies of a text share: a group of copies counts about once, so its own words are no marks of a label."""
    for frame, texts in batches(frames):
        yield frame.assign(key=[int(s[:1].view(np.int64)[0]) if len(s) else 0 for s in shingle_sets(texts)])


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """A grammar from the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order).limit(SAMPLE).union(known.where("toxic = 0").orderBy(order).limit(SAMPLE))
    # at most 2 * SAMPLE rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = rows.select("toxic", "text").mapInPandas(tidy(_keyed), "toxic int, text string, key long")
    rows = table(rows.groupBy("toxic", "key").agg(F.min("text").alias("text")))
    total = dict(rows.groupBy("toxic").count().collect())
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic:
        return Grammar({}, {})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pd.DataFrame:
            rows = [(a, w, n[1][a, w], n[0][a, w]) for a, w in n[0].keys() | n[1].keys()]
            for c in n:
                c.clear()
            return pd.DataFrame(rows, columns=["atom", "whole", "t", "c"])

        for frame in frames:
            for label, text in zip(frame["toxic"], frame["text"], strict=True):
                n[label].update(atoms(text))
                if len(n[0]) + len(n[1]) > HELD:
                    yield out()
        yield out()

    counts = rows.mapInPandas(tidy(count), "atom string, whole boolean, t long, c long").groupBy("atom", "whole").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t"), F.col("c")
    low, high = t - SIGMAS * F.sqrt(t), c + SIGMAS * F.sqrt(c + 0.25) + 0.5
    bears = (t >= max(SUPPORT, toxic // 100)) & (low > 0) & (F.log(low / (toxic + 1)) - F.log(high / (clean + 1)) >= ODDS - 1e-9)
    chosen = lexicon({(r["atom"], r["whole"]): (r["t"], r["c"]) for r in counts.where(bears).collect() if not (r["whole"] and r["atom"] in LISTED)}, toxic, clean)
    grammar = Grammar({a: chosen[a, w] for a, w in chosen if w}, {a: chosen[a, w] for a, w in chosen if not w})
    return _calibrated(grammar, rows)


def lexicon(n: dict[tuple[str, bool], tuple[int, int]], toxic: int, clean: int) -> dict[tuple[str, bool], float]:
    """Entries with weights from (toxic, clean) document counts of atoms.

    A weight is the log-odds at the cautious ends of both counts (SIGMAS standard deviations), so rare chance words weigh little. Of
    nested beginnings with about the same toxic documents the longest stands, and one that owes much of them to a
    far surer longer entry goes; a longer entry that weighs no more than a chosen beginning of it adds nothing."""
    odds = {}
    for a, (t, c) in n.items():
        low, high = t - SIGMAS * math.sqrt(t), c + SIGMAS * math.sqrt(c + 0.25) + 0.5
        if low > 0 and (w := math.log(low / (toxic + 1)) - math.log(high / (clean + 1))) >= ODDS:
            odds[a] = min(4.0, w)
    parents = lambda a: ((a[0][:k], False) for k in BEGINNINGS if k < len(a[0]) + a[1])
    general = {p for a in odds for p in parents(a) if p in odds and (n[a][0] >= 0.9 * n[p][0] or n[a][0] >= 0.4 * n[p][0] and odds[a] >= odds[p] + 1)}
    out: dict[tuple[str, bool], float] = {}
    for a in sorted(odds.keys() - general, key=lambda a: (len(a[0]) + a[1], a)):
        if not any(out.get(p, 0) >= odds[a] - 0.3 for p in parents(a)):
            out[a] = odds[a]
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0])))


def _calibrated(grammar: Grammar, rows: DataFrame) -> Grammar:
    """bias and pattern weights by logistic regression with shrinkage to first_weights() over the learning rows (at most 2 * SAMPLE, a dozen numbers each); no match makes a document cleaner."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "evidence": [scanner.evidence(t) for t in frame["text"]]})

    found = rows.select("toxic", "text").mapInPandas(tidy(scan), "toxic int, evidence array<double>").toPandas()
    x, y = np.stack(found["evidence"]), found["toxic"].to_numpy(float)
    x = np.hstack([np.ones((len(x), 1)), np.minimum(x, MOST)])
    start = np.array([BIAS, *(grammar.weights[p] for p in PATTERNS)])
    at = start.copy()

    def cost(v: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + PRIOR / 2 * ((v - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(len(at)), x.T @ (p - y) + PRIOR * (at - start))
        while cost(at - step) > cost(at) and np.abs(step).max() > 1e-9:  # separable rows make whole steps overshoot
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(grammar.words, grammar.beginnings, float(at[0]), {p: max(float(w), 0.0) for p, w in zip(PATTERNS, at[1:], strict=True)})


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(shared.value)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [scanner.score(t) for t in frame["text"]]})

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(tidy(scan), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs without the rows whose text is predicted toxic; each row is judged by its own text, whatever its doc_id."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    made: dict[str, Scanner] = {}

    def clean(values: list[str | None]) -> list[bool]:
        if not made:
            made["scanner"] = Scanner(shared.value)
        return [made["scanner"].score(t) < THRESHOLD for t in values]

    return select_rows(docs, clean)
