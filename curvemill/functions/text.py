"""Text normalisation and strict payload checks as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Fixed folding of names.
FOLD = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def normalize_token(value: Column) -> Column:
    """Lower case, umlauts folded, only letters and digits kept. Decomposed umlauts are not folded."""
    out = F.lower(value)
    for a, b in FOLD:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "")


def parse_curve(payload: Column) -> Column:
    """The curve of a strict {"cdf": [11 numbers]} payload, or null: no other keys, no text or booleans for numbers, strict curve rules, never repaired."""
    from .curves import is_strict_curve

    keys = F.json_object_keys(payload)
    element = F.from_json(payload, "struct<cdf: array<string>>")["cdf"]
    raw = F.get_json_object(payload, "$.cdf")
    # quotes, braces or words inside the array mean an element that is not a number
    numeric = raw.rlike(r"^\[[-+0-9.eE, \t\r\n]*\]$")
    cdf = F.transform(element, lambda x: x.try_cast("double"))
    ok = (F.size(keys) == 1) & (F.get(keys, F.lit(0)) == "cdf") & numeric & (F.size(element) == 11)
    return F.when(F.coalesce(ok & is_strict_curve(cdf), F.lit(False)), cdf)


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object sorted, at every level, and without blanks: equal values have equal texts. Null for text that is no JSON.

    A Variant keeps an object's fields in the order of their keys, and numbers without needless zeros. A key that an object has twice counts as no JSON."""
    return F.to_json(F.try_parse_json(text))


def line_class(line: Column, patterns: dict[str, str]) -> Column:
    """struct(kind, captures): the first of patterns (name -> regular expression) that matches the whole line, with its groups; a line that none matches raises when the rows are used."""
    kind = F.raise_error(F.concat(F.lit("unexpected line: "), line)).cast("struct<kind:string,captures:array<string>>")
    for name, pattern in reversed(patterns.items()):
        whole = f"^(?:{pattern})$"
        groups = re.compile(whole).groups
        captures = F.array(*(F.regexp_extract(line, whole, i + 1) for i in range(groups))).cast("array<string>")
        kind = F.when(line.rlike(whole), F.struct(F.lit(name).alias("kind"), captures.alias("captures"))).otherwise(kind)
    return kind


def occurrences(text: Column, part: str) -> Column:
    """How often part stands in text, without overlaps."""
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def replace_once(text: Column, part: str, new: str) -> Column:
    """text with part replaced, which must stand in it exactly once; else it raises when the rows are used."""
    return F.when(text.isNull(), None).when(occurrences(text, part) == 1, F.replace(text, F.lit(part), F.lit(new))).otherwise(F.raise_error(F.lit(f"{part!r} is not there exactly once")).cast("string"))


def replace_lines(text: Column, first: int, last: int, new: list[Column]) -> Column:
    """text with its lines first to last (from 0, last excluded) replaced by others."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, 1, first), F.array(*new).cast("array<string>"), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))), "\n")


def shown(value: Column, digits: int) -> Column:
    """A number with fixed digits, n/a for null or NaN."""
    return F.when(value.isNull() | F.isnan(value), "n/a").otherwise(F.format_string(f"%.{digits}f", value))
