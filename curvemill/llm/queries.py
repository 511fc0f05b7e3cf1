"""The thin queries opN_<name> over the documents and pages tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import cotrain, decontaminate, mixture
from .bpe import encode_decode
from .html_text import extract
from .importance import importance
from .lines import dedup_lines, quality_rules
from .ngram_join import near_duplicates
from .repair import structure_repair
from .shared import table
from .toxicity import learn, toxicity
from .warc import archived
from .wavelet import token_files

TOKENIZER = "word_bpe_49k.json"


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(cotrain.featured(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return cotrain.scored(rows, cotrain.train_on(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_warc, op3_toxicity, op4_token_files, op5_bpe, op6_line_dedup, op7_quality, op8_leaks, op9_ngram_join, op10_quality_rules, op11_importance, op12_repair, op13_mixture)}


_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]+"
_LINES = "string_split(coalesce(text, ''), chr(10))"
_NORM = f"trim(regexp_replace(lower(x), '{_BLANK}', ' ', 'g'), ' ')"
_HOST = "coalesce(source, '')"
# lines of each host that are in more than a tenth of its documents and in five of them; rid tells rows apart
_OVER = f"""d AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT DISTINCT doc_id, {_HOST} AS h, {_NORM} AS line FROM (SELECT doc_id, source, unnest({_LINES}) AS x FROM documents) WHERE regexp_matches(x, '{_WORD}')),
pages AS (SELECT h, count(*) AS pages FROM (SELECT DISTINCT {_HOST} AS h, doc_id FROM documents) GROUP BY 1),
gone AS (SELECT h, list(line) AS lines FROM (SELECT h, line FROM l JOIN pages USING (h) GROUP BY h, line, pages HAVING count(*) >= 5 AND count(*) > 0.1 * pages) GROUP BY h),
kept AS (SELECT d.*, CASE WHEN lines IS NULL THEN text ELSE array_to_string(list_filter({_LINES}, lambda x: NOT list_contains(lines, {_NORM}) OR NOT regexp_matches(x, '{_WORD}')), chr(10)) END AS left_text FROM d LEFT JOIN gone ON h = {_HOST})"""

_OP6 = f"WITH {_OVER} SELECT doc_id, left_text AS text, lang, source, CASE WHEN left_text IS DISTINCT FROM text THEN length(left_text) ELSE n_chars END AS n_chars FROM kept"

_OP10 = f"""WITH {_OVER}, w AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 7)),
twice AS (SELECT rid, win FROM win GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM win JOIN twice USING (rid, win), range(8) r(k) GROUP BY 1),
m AS (SELECT k.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
len(list_filter({_LINES}, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter({_LINES}, lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines,
coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(coalesce(left_text, ''), '{_WORD}'))::BIGINT AS words_left
FROM kept k JOIN w USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * words_left >= n_words AS kept, words_left FROM m"""

_OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


# CRC-32 by its table of 256 entries, byte by byte
_CRC = """crc_table AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, i) ORDER BY i) AS tab FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8 bytes; crc_table must be in scope."""
    data = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


_OP11 = f"""WITH {_CRC}, w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT rid, f, count(*) AS c FROM (SELECT rid, unnest(w) AS f FROM w) GROUP BY 1, 2),
b AS (SELECT f, count(*) AS t FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f FROM benchmark) GROUP BY 1),
k AS (SELECT f, coalesce(s, 0) AS s, coalesce(t, 0) AS t, {_crc("f")} % 10000 AS bucket FROM (SELECT f, sum(c)::BIGINT AS s FROM f GROUP BY 1) FULL JOIN b USING (f), crc_table),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((sum(t) + 1)::DOUBLE * ((SELECT sum(s) FROM k) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * ((SELECT sum(t) FROM k) + 10000)::DOUBLE)))::BIGINT AS gain FROM k GROUP BY 1),
v AS (SELECT rid, sum(c * gain)::BIGINT AS weight FROM f JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
z AS (SELECT doc_id, rid, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN v USING (rid)),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (rid)"""

def _then(state: str, cost: str | int, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{edit}'}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


# edits as a walk over the rows: the best (cost, audit) of each state (0 nothing yet, 1 after the system row, 2 after a user's, 3 after an assistant's), with two inserted rows at most before each row
_INSERTED = lambda x: f"{x}0 AS i0, {x}1 AS i1, {_least(x + '2', _then(x + '0', 5, 'I'), _then(x + '1', 5, 'I'), _then(x + '3', 5, 'I'))} AS i2, {_least(x + '3', _then(x + '2', 5, 'I'))} AS i3"
_FAR = "{'c': 1000000000, 's': ''}"
_KEEP = lambda state, initial: f"CASE WHEN lower(code) = '{initial}' THEN {_then(state, 'pen', 'K')} ELSE {_FAR} END"
_ROLE = lambda state: f"CASE WHEN code <> 'x' THEN {_then(state, '1 + pen', 'R')} ELSE {_FAR} END"
_STEP = f"""{_then('j0', 2, 'D')} AS e0, {_least(_then('j1', 2, 'D'), _KEEP('j0', 's'))} AS e1,
{_least(_then('j2', 2, 'D'), *(f(x) for x in ('j0', 'j1', 'j3') for f in (_ROLE, lambda x: _KEEP(x, 'u'))))} AS e2, {_least(_then('j3', 2, 'D'), _ROLE('j2'), _KEEP('j2', 'a'))} AS e3"""
_OP12 = f"""WITH RECURSIVE {_CRC}, r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, again FROM r, range(2) g(again) WHERE k <> 0 AND (again = 0 OR k = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS seen, coalesce(regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1), '') AS last FROM d),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
g AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS code, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS pen FROM f),
steps(conv_id, i, e0, e1, e2, e3) AS (SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 's': ''}}, {_FAR}, {_FAR}, {_FAR} FROM conversations
UNION ALL SELECT conv_id, i, {_STEP} FROM (SELECT conv_id, i, code, pen, {_INSERTED('i').replace(' AS i', ' AS j')} FROM (SELECT g.conv_id, g.i, g.code, g.pen, {_INSERTED('e')} FROM steps s JOIN g ON g.conv_id IS NOT DISTINCT FROM s.conv_id AND g.i = s.i + 1))),
best AS (SELECT conv_id, {_least('e0', 'e3', _then('e2', 5, 'I'), _then('e1', 10, 'II'))} AS b FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
chars AS (SELECT conv_id, j, b.s[j] AS e, count(CASE WHEN b.s[j] <> 'I' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM (SELECT conv_id, b, unnest(range(1, length(b.s) + 1)) AS j FROM best)),
outs AS (SELECT c.conv_id, c.j, c.e, g.role, g.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.j) - 1 AS m, first_value(c.e = 'K' AND g.role[1] = 's') OVER (PARTITION BY c.conv_id ORDER BY c.j) AS s FROM chars c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id AND g.i = c.i WHERE c.e <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - s::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY m) AS said FROM outs GROUP BY 1),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.b.c::BIGINT AS cost, b.b.s AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best b LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM b.conv_id"""

# the level is that of the first source, by the size it is clamped at for each unit of weight, that stays below its clamp; the walk goes row by row
_OP13 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
('0x' || substr(md5('2024:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * n AS cap, sum(2.0::DOUBLE * n) OVER r AS caps, sum(w) OVER r AS ws, sum(n) OVER () AS total, sum(w) OVER () AS weight FROM s WINDOW r AS (ORDER BY n / w, source NULLS LAST)),
e AS (SELECT *, (1.5::DOUBLE * total - (caps - cap)) / (weight - (ws - w)) AS level FROM o),
level AS (SELECT arg_min(level, ws) AS level FROM e WHERE w * level <= cap),
t AS (SELECT source, n, CASE WHEN l.level IS NULL OR w * l.level > cap THEN cap ELSE w * l.level END AS target FROM o, level l),
plan AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS whole FROM t),
walk AS (SELECT rid, source, size, row_number() OVER (PARTITION BY source ORDER BY place) AS i FROM d),
step(source, i, rid, gap, most, missed, more) AS (SELECT source, 0::BIGINT, NULL::BIGINT, greatest(0, target - whole * n), greatest(0, target - whole * n), 0, false FROM plan
UNION ALL SELECT s.source, k.i, k.rid, CASE WHEN missed < 4 AND size <= most AND size <= gap THEN gap - size ELSE gap END, CASE WHEN missed < 4 AND size <= most AND size > gap THEN gap ELSE most END,
missed + (missed < 4 AND size <= most AND size > gap)::INT, missed < 4 AND size <= most AND size <= gap FROM step s JOIN walk k ON k.source IS NOT DISTINCT FROM s.source AND k.i = s.i + 1)
SELECT doc_id, size, n AS source_size, target, size * (whole + more::INT) AS taken FROM d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source JOIN (SELECT rid, more FROM step WHERE rid IS NOT NULL) USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": _OP6, "op9_ngram_join": _OP9, "op10_quality_rules": _OP10, "op11_importance": _OP11, "op12_repair": _OP12, "op13_mixture": _OP13}
