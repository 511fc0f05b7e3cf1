"""Conversation structure repair: each conversation's rows are made to read system?, then user and assistant in turn, by the cheapest edits.

Rows are taken by turn (nulls first; rows of one turn by role, then by a digest of role and text). A row's first fault counts: blank (no character but
white space), duplicate (role and text seen earlier in the conversation), truncated (its last such character ends no sentence). Edits of a row: Keep (0),
Rerole to user or assistant (1), Delete (2; the only one for blank and duplicate rows); an empty user or assistant row may be Inserted anywhere (5);
a truncated row that stays costs 5 more. Of the cheapest edits those with the least string of initials win.

A conversation's roles and faults are a compact string, its signature, with a character a row. Each distinct signature is solved once, by recursion over its
halves: a part is the best edits from each state of the role grammar to each other, and parts of up to MEMO characters are remembered, as many conversations share them.
The audits are joined back by signature, the frequent ones by broadcast (FREQUENT of at most LONG characters), and edits are replayed over the rows.

Signatures are built, and edits replayed, from rows that Spark has sorted by conversation and turn, one row after another: a task holds a character
for each row of the conversation at hand, never its texts. Duplicates are found by a window over conversation and digest, not by keeping what was seen.

Nulls in role and text count as one space. A null conversation id is a conversation of its own. Unknown roles (also the empty one) are never kept. A conversation whose rows
are all `dropped` has zeros and an empty audit. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .lines import BLANKS
from .shared import small_batches, table, tidy

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Longest part whose solution is remembered, and how many of them in a task.
MEMO, REMEMBERED = 64, 20_000
#: A signature of at least this part of all conversations and at most LONG characters is joined by broadcast, so FREQUENT x LONG characters of signatures at most.
FREQUENT, LONG = 1000, 4096

# states of the role grammar: nothing yet, after the system row, after a user's, after an assistant's
START, SYSTEM, USER, ASSISTANT = range(4)
#: What comes next if a row is inserted or gets a new role.
FORCED = {START: (USER, b"user"), SYSTEM: (USER, b"user"), USER: (ASSISTANT, b"assistant"), ASSISTANT: (USER, b"user")}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Rows to insert at the end, by state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Part = dict[tuple[int, int], tuple[int, str]]


def _single(code: str) -> Part:
    """A row's best edits between states: x is a row to delete, s, u, a and o are roles, capitals are truncated rows."""
    best: Part = {}

    def offer(a: int, b: int, cost: int, audit: str) -> None:
        if (a, b) not in best or (cost, audit) < best[a, b]:
            best[a, b] = cost, audit

    for a in range(4):
        at = a
        for inserted in range(3):  # three rows inserted before one row never pay
            cost, audit = INSERT * inserted, "I" * inserted
            offer(a, at, cost + DELETE, audit + "D")
            if code != "x":
                stay = cost + CUT * code.isupper()
                offer(a, FORCED[at][0], stay + REROLE, audit + "R")
                if at in (kept := KEPT.get(code.lower(), {})):
                    offer(a, kept[at], stay + KEEP, audit + "K")
            at = FORCED[at][0]
    return best


def _joined(left: Part, right: Part) -> Part:
    """Best edits of two parts one after the other. No best audit of a part is the beginning of another one between the same states, so the least of each make the least of both."""
    best: Part = {}
    for (a, b), (cost, audit) in left.items():
        for c in range(4):
            if (b, c) in right:
                more, rest = right[b, c]
                if (a, c) not in best or (cost + more, audit + rest) < best[a, c]:
                    best[a, c] = cost + more, audit + rest
    return best


def _part(codes: str) -> Part:
    return _remembered(codes) if len(codes) <= MEMO else _halves(codes)


def _halves(codes: str) -> Part:
    if len(codes) == 1:
        return _single(codes)
    cut = 1 << (len(codes) - 1).bit_length() - 1  # a power of two, so that equal beginnings are cut alike
    return _joined(_part(codes[:cut]), _part(codes[cut:]))


_remembered = lru_cache(REMEMBERED)(_halves)


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of a signature."""
    if not signature:
        return 0, ""
    ends = ((cost + INSERT * CLOSING[b], audit + "I" * CLOSING[b]) for (a, b), (cost, audit) in _part(signature).items() if a == START)
    return min(ends)


def replayed(audit: str, rows: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of each row of the repaired conversation."""
    state, rows = START, iter(rows)
    for edit in audit:
        if edit == "I":
            state, role = FORCED[state]
            yield edit, role, b""
            continue
        role, text = next(rows)
        if edit == "R":
            state, role = FORCED[state]
        elif edit == "K":
            state = KEPT[role[:1].decode()][state]
        if edit != "D":
            yield edit, role, text


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, again, dropped) of conversation rows, damaged by the CRC-32 of id and turn modulo 20: 0 drops a row, 1 empties it, 2 takes out its ends of
    sentences, 3 repeats it (again is 1 in the copy), 4 makes it the user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of(text), "[.!?]", "")).otherwise(text_of(text))
    again = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(text_of(role)).alias("role"), new.alias("text"), again.alias("again"), (kind == 0).alias("dropped"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


#: The order of rows (Spark puts nulls first); it starts with what tells conversations apart.
ORDER = ("conv", "turn", "role", "mark", "again")
FAULTS = ("blank", "duplicate", "truncated")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, again, dropped, fault) of rows (conv, turn, role, text, again, dropped): fault is the name of a row's first one, or empty."""
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    marked = rows.select("conv", "turn", "role", _digest(F.col("role"), F.col("text")).alias("mark"), "again", "dropped", last.alias("last"))
    earlier = F.row_number().over(Window.partitionBy("conv", "mark", "dropped").orderBy("turn", "again")) > 1
    fault = F.when(F.col("last") == "", "blank").when(earlier, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    return marked.withColumn("fault", fault).drop("last")


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) of the rows of faults()."""
    ordered = rows.repartition("conv").sortWithinPartitions(*ORDER)
    names = ["gaps", *FAULTS, "illegal"]
    shape = T.StructType([ordered.schema["conv"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("signature", T.StringType())])

    @tidy
    def build(batches):
        import pyarrow as pa

        legal, kind, held = {"su", "ua", "au"}, None, []
        conv, begun, last, turn, counts, codes = None, False, None, None, {}, bytearray()

        def close():
            gaps = turn[1] - turn[0] + 1 - turn[2] if turn else 0
            held.append((conv, gaps, *(counts.get(n, 0) for n in names[1:]), codes.decode()))

        def out():
            columns = list(zip(*held, strict=True)) or [()] * len(shape)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *[pa.int64()] * 5, pa.string()), strict=True)], shape.names)

        for batch in batches:
            kind = batch.schema.field("conv").type
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("conv", "turn", "role", "dropped", "fault")}
            for own, number, role, dropped, fault in zip(at["conv"], at["turn"], at["role"], at["dropped"], at["fault"], strict=True):
                if not begun or own != conv:
                    if begun:
                        close()
                    conv, begun, last, turn, counts, codes = own, True, None, None, {}, bytearray()
                if dropped:
                    continue
                if number is not None:
                    turn = (turn[0], number, turn[2] + (number != turn[1])) if turn else (number, number, 1)
                if last is not None and last + role[:1] not in legal:
                    counts["illegal"] = counts.get("illegal", 0) + 1
                last = role[:1]
                counts[fault] = counts.get(fault, 0) + 1
                code = "x" if fault in ("blank", "duplicate") else last if last in KEPT else "o"
                codes += (code.upper() if fault == "truncated" else code).encode()
            if len(held) > 10_000:
                yield out()
        if begun:
            close()
            yield out()

    return ordered.mapInArrow(build, shape)


def solved(found: DataFrame) -> DataFrame:
    """found (a written table of signatures()) with cost and audit; each distinct signature is solved once."""

    @tidy
    def each(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(0).to_pylist()
            costs, audits = zip(*map(solve, texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["signature", "n", "cost", "audit"])

    distinct = found.groupBy("signature").agg(F.count("*").alias("n"))
    answers = table(distinct.mapInArrow(each, "signature string, n bigint, cost bigint, audit string"))
    hot = (F.col("n") * FREQUENT >= found.count()) & (F.length("signature") <= LONG)
    many, few = answers.where(hot).drop("n"), answers.where(~hot).drop("n")
    first = found.join(F.broadcast(many.withColumnsRenamed({"cost": "hot_cost", "audit": "hot_audit"})), "signature", "left")
    rest = first.where("hot_audit is null").drop("hot_cost", "hot_audit").join(few, "signature")
    return first.where("hot_audit is not null").withColumnsRenamed({"hot_cost": "cost", "hot_audit": "audit"}).unionByName(rest)


STATISTICS = ("gaps", *FAULTS, "illegal", "cost", "audit")


def audits(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, signature) of rows (conv, turn, role, text, again, dropped)."""
    small_batches(rows.sparkSession)
    return solved(table(signatures(faults(rows))))


def _beside_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows, sorted in the tasks that will replay them."""
    rows = rows.where("not dropped").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    each = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", _digest(F.col("role"), F.col("text")).alias("mark"), "again", F.col("text").cast("binary").alias("text"))
    heads = found.select("conv", F.lit(0).alias("kind"), *STATISTICS)
    both = each.unionByName(heads, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:])
    return both.select("conv", "kind", F.col("role").cast("binary").alias("role"), "text", *STATISTICS)


def _conversations(batches) -> Iterator[tuple[dict, Iterator[tuple[bytes, bytes]]]]:
    """(audit row, its rows' roles and texts) of the sorted rows of _beside_audits; the rows must be taken before the next conversation."""
    head = None

    def each():
        for batch in batches:
            names, columns = batch.schema.names, [batch.column(i) for i in range(batch.num_columns)]
            kinds, roles, texts = (columns[names.index(n)] for n in ("kind", "role", "text"))
            for i, kind in enumerate(kinds.to_pylist()):
                if kind:
                    yield None, (roles[i].as_py(), texts[i].as_py())
                else:
                    yield {n: c[i].as_py() for n, c in zip(names, columns, strict=True) if n not in ("kind", "role", "text")}, None

    stream = each()
    head, _ = next(stream, (None, None))
    while head is not None:
        following: list[dict | None] = [None]

        def rows(following=following):
            for new, row in stream:
                if new is not None:
                    following[0] = new
                    return
                yield row

        own = rows()
        yield head, own
        for _ in own:  # whatever was not taken
            pass
        head = following[0]


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, statistics, repaired_sha256): the digest of role:text of the repaired rows, joined by line feeds."""
    sorted_rows = _beside_audits(rows, found)
    shape = T.StructType([sorted_rows.schema["conv"], *(sorted_rows.schema[c] for c in STATISTICS), T.StructField("repaired_sha256", T.StringType())])

    @tidy
    def digest(batches):
        import hashlib

        import pyarrow as pa

        def known(batches):
            for batch in batches:
                kinds.setdefault("conv", batch.schema.field("conv").type)
                yield batch

        def out():
            columns = {n: pa.array([h[n] for h in held], kinds["conv"] if n == "conv" else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in shape.names}
            held.clear()
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        kinds, held = {}, []
        for head, own in _conversations(known(batches)):
            sha, first = hashlib.sha256(), True
            for _, role, text in replayed(head["audit"], own):
                sha.update((b"" if first else b"\n") + role + b":")
                sha.update(text)
                first = False
            held.append(head | {"repaired_sha256": sha.hexdigest()})
            if len(held) > 10_000:
                yield out()
        if held:
            yield out()

    return sorted_rows.mapInArrow(digest, shape)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, place from 0."""
    sorted_rows = _beside_audits(rows, found)
    shape = T.StructType([sorted_rows.schema["conv"], T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])

    @tidy
    def write(batches):
        import pyarrow as pa

        def out():
            conv, place, edit, role, text = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(conv, kinds["conv"]), pa.array(place, pa.int64()), pa.array(edit, pa.string()), *(pa.array([x.decode() for x in c], pa.string()) for c in (role, text))], shape.names)

        def known(batches):
            for batch in batches:
                kinds.setdefault("conv", batch.schema.field("conv").type)
                yield batch

        kinds, held, size = {}, [], 0
        for head, own in _conversations(known(batches)):
            for place, (edit, role, text) in enumerate(replayed(head["audit"], own)):
                held.append((head["conv"], place, edit, role, text))
                size += len(text)
                if len(held) > 2000 or size > 4 << 20:
                    yield out()
                    size = 0
        if held:
            yield out()

    return sorted_rows.mapInArrow(write, shape)


def structure_repair(conversations: DataFrame) -> DataFrame:
    """The report of a table of conversations (conv_id, turn, role, text) that damaged() went over: a row a conversation."""
    rows = damaged(conversations)
    return digests(rows, audits(rows)).withColumnRenamed("conv", "conv_id")
