"""Line frequency within a host, with DataFrame functions only: line dedup and cross-document quality rules.

A line is a piece of the text between line feeds; its normal form is lower case, trimmed, with runs of white space as one
space. Blank lines have no normal form and are never counted or removed. What is counted, of lines and of a host's pages, is distinct
documents: rows of one doc_id in one host are one document, whatever their texts, and rows without doc_id are one together. A null host
(or source) is a host of its own, shared with the empty one. 64-bit hashes stand for lines.

Counts are made of (host, line) pairs after a partial count in each task, so that no hot host or line gathers in one
place. Rows are counted first; that is never less than the documents, so where ids repeat only the lines that rows put over the limit are
counted again by documents. Lines over the limit are grouped by host; there are few a host (at most lines a document / ratio), and the
table is broadcast only when its counted bytes are small, otherwise joined by shuffle.

Null texts have no lines; texts of any length are taken whole; an empty table gives an empty result; helper columns never clash with the table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import by_position, fresh, sized, table

#: White space that separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = "[\\x20\\x09-\\x0D]"
#: A line in more than this share of its host's documents, and at least this many of them, is boilerplate.
RATIO, LEAST = 0.1, 5
#: A document is depleted if less than this share of its words is left.
LEFT = 0.5
#: Removed lines (8 bytes each) of all hosts that are broadcast at most.
BROADCAST_LINES = 1_000_000


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), f"{BLANK}+", " "))


def has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(BLANKS)) != ""


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _hash(line: Column) -> Column:
    return F.when(has_word(line), F.xxhash64(normal(line)))


def frequent_lines(docs: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = LEAST, doc: str = "doc_id") -> DataFrame:
    """(host, lines, n_lines): the hashes of the host's lines that are in more than ratio of its documents and in least of them."""
    docs = docs.select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    pages = docs.groupBy("host", "doc").agg(F.count("*").alias("rows")).groupBy("host").agg(F.sum("rows").alias("rows"), F.count("*").alias("pages"))
    pages = table(pages)
    each = docs.select("host", "doc", F.explode(F.array_distinct(F.transform(_lines("text"), _hash))).alias("line")).where("line is not null")

    def over(lines: DataFrame) -> DataFrame:
        """(host, line) of the lines that enough rows of lines hold."""
        n = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        return n.join(pages, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).select("host", "line")

    found = over(each)
    if not pages.where("rows > pages").isEmpty():
        found = over(each.join(sized(table(found)), ["host", "line"], "left_semi").distinct())
    return table(found.groupBy("host").agg(F.collect_list("line").alias("lines"), F.count("*").alias("n_lines")))


def with_frequent(docs: DataFrame, over: DataFrame, host: str, lines: str) -> DataFrame:
    """docs with the lines of over as a column of that name, joined by broadcast only within BROADCAST_LINES."""
    total = over.agg(F.sum("n_lines")).first()[0] or 0
    (key,) = fresh(docs, "host")
    small = over.select(F.col("host").alias(key), F.col("lines").alias(lines))
    small = F.broadcast(small) if total <= BROADCAST_LINES else small
    return docs.join(small, F.coalesce(docs[host], F.lit("")) == F.col(key), "left").drop(key)


def _kept(text: str, over: str) -> Column:
    keep = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(F.col(over), _hash(x)), F.lit(False)))
    return F.when(F.col(over).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, doc: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """docs with the boilerplate lines of each host taken out of text. A text of null stays null; rows are never dropped; size, where there is such a column, is counted again for texts that changed; other columns stay, whatever their names."""
    plain, names = by_position(docs)
    host, text, doc, size = names[host], names[text], names[doc], names.get(size)
    out = with_frequent(plain, frequent_lines(plain, host, text, ratio, least, doc), host, "lines").withColumn("left", _kept(text, "lines"))
    new = {text: F.col("left")}
    if size:
        new[size] = F.when(F.col("left").eqNullSafe(F.col(text)), F.col(size)).otherwise(F.char_length("left").cast(dict(plain.dtypes)[size]))
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Words without an array of them: word starts are a non-blank at the beginning or after a blank."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


#: The symbols that count as such.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def _repeated(words: Column) -> Column:
    """Words in windows of eight that come twice or more in the array."""
    n = F.size(words)
    each = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(each, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - WINDOW + 1), lambda i: F.xxhash64(F.slice(e, i, WINDOW))))

    def covered(windows: Column) -> Column:
        same = lambda s, i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = _let(
            F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.filter(s, lambda x, i: ((i > 0) & same(s, i, i - 1)) | ((i < F.size(s) - 1) & same(s, i, i + 1))),
        )
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        # each window adds the words up to the next one's start, eight at most
        return F.aggregate(at, F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).cast("long").alias("sum")), lambda a, p: F.struct(p.alias("end"), (a["sum"] + F.least(F.lit(WINDOW), p - a["end"])).alias("sum")))["sum"]

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), 0)


def measures(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), has_word)
    # one struct of what the words give, and _let so that no lambda computes it again
    counts = _let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")))
    fields = lambda c: F.struct(
        c["n_words"].alias("n_words"),
        c["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
    )
    return _let(counts, fields)


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST, left: float = LEFT) -> DataFrame:
    """One row per row of docs: doc_id, the measures, words_left (after the host's frequent lines are taken out), base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of them in repeated windows. kept: not base_failed, and at
    least `left` of the words remain. Null and empty texts fail. Ties count as equal everywhere."""
    over = with_frequent(docs.select("doc_id", F.col(host).alias("source"), F.col(text).alias("text")), frequent_lines(docs, host, text, ratio, least), "source", "lines")
    left_words = F.when(F.col("lines").isNotNull(), count_words(F.coalesce(_kept("text", "lines"), F.lit("")))).cast("long")
    # inline() rather than struct fields: the optimizer would repeat the struct for each field
    m = over.select("doc_id", left_words.alias("w"), F.inline(F.array(measures(F.col("text")))))
    out = m.withColumn("words_left", F.coalesce("w", "n_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.lit(left) * F.col("n_words"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")
