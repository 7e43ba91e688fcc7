"""Texts and small numbers of the source databases, where Spark's function of the name means something else or is missing."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from driftframe.functions.json_values import json_value

_WORDS = r"regexp_extract_all(s, '([\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+)', 1)"
#: Places where a part stands, overlaps included.
_PLACES = "filter(sequence(1, greatest(1, length(s) - length(part) + 1)), i -> substr(s, i, length(part)) = part)"
_FROM_END = "length(s) + start + 1"

#: Name, arguments, result and body of each.
FUNCTIONS = (
    # a word is letters and digits, so what stands behind any other character is in capitals too
    ("initcap_words", "s STRING", "STRING", f"array_join(transform({_WORDS}, w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), '')"),
    # 0 counts as 1; before the beginning there is nothing, and an empty text is null
    ("ora_substr", "s STRING, start INT, n INT", "STRING", "nullif(CASE WHEN n < 1 OR abs(start) > length(s) THEN NULL ELSE substr(s, start, n) END, '')"),
    # the characters at start to start + n - 1, as far as there are such
    ("pg_substring", "s STRING, start INT, n INT", "STRING", "CASE WHEN n < 0 THEN raise_error('negative substring length') ELSE substr(s, greatest(start, 1), greatest(CAST(CAST(start AS BIGINT) + n - greatest(start, 1) AS INT), 0)) END"),
    # a negative start counts from the end and searches towards the beginning
    ("ora_instr", "s STRING, part STRING, start INT, nth INT", "INT", f"CASE WHEN s IS NULL OR part IS NULL OR s = '' OR part = '' OR nth < 1 THEN NULL WHEN start = 0 THEN 0 WHEN start > 0 THEN coalesce(try_element_at(filter({_PLACES}, i -> i >= start), nth), 0) ELSE coalesce(try_element_at(reverse(filter({_PLACES}, i -> i <= {_FROM_END})), nth), 0) END"),
    ("ora_lengthb", "s STRING", "INT", "octet_length(s)"),
    # no separator divides into characters, an empty one not at all; what equals the last argument is null
    ("pg_string_to_array", "s STRING, sep STRING, nulls STRING", "ARRAY<STRING>", r"transform(CASE WHEN s IS NULL THEN NULL WHEN s = '' THEN CAST(array() AS ARRAY<STRING>) WHEN sep IS NULL THEN regexp_extract_all(s, '([\\s\\S])', 1) WHEN sep = '' THEN array(s) ELSE split(s, concat('\\Q', replace(sep, '\\E', '\\E\\\\E\\Q'), '\\E')) END, x -> nullif(x, nulls))"),
    ("pg_array_length", "x ARRAY<STRING>, dimension INT", "INT", "IF(dimension = 1 AND size(x) > 0, size(x), NULL)"),
    ("pg_array_to_string", "x ARRAY<STRING>, sep STRING, nulls STRING", "STRING", "array_join(IF(nulls IS NULL, array_compact(x), transform(x, v -> coalesce(v, nulls))), sep)"),
    ("pg_div", "a DOUBLE, b DOUBLE", "DOUBLE", "IF(a / b < 0, ceil(a / b), floor(a / b))"),
    ("pg_log", "x DOUBLE", "DOUBLE", "log10(x)"),
    # below the first bound 0, from the last on one more than n; bounds may fall
    ("bucket_number", "x DOUBLE, low DOUBLE, high DOUBLE, n INT", "INT", "CASE WHEN n < 1 OR low = high THEN NULL WHEN IF(low < high, x < low, x > low) THEN 0 WHEN IF(low < high, x >= high, x <= high) THEN n + 1 ELSE CAST(floor((x - low) / (high - low) * n) AS INT) + 1 END"),
)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_present(*columns: str | Column) -> Column:
    """The texts that are there, one behind the other; never null."""
    return F.concat(*(F.coalesce(_column(c).cast("string"), F.lit("")) for c in columns))


def ratio_to_report(c: str | Column, *keys: str | Column) -> Column:
    """A value's part in the sum of its group, null where the sum is zero."""
    return _column(c) / F.nullif(F.sum(_column(c)).over(Window.partitionBy(*keys)), F.lit(0))


_UNSHIFTED = re.compile(r"\\[1-9]|\(\?(?!:)")


def regexp_match(c: str | Column, pattern: str) -> Column:
    """Array of the groups of a pattern's first match, of the match itself where it has no group; null where none matches. A group that took no part is empty."""
    groups = re.compile(pattern).groups
    return F.when(F.regexp_like(_column(c), F.lit(pattern)), F.array(*(F.regexp_extract(_column(c), pattern, i) for i in (range(1, groups + 1) if groups else (0,)))))


def regexp_replace(c: str | Column, pattern: str, text: str, flags: str = "") -> Column:
    r"""A pattern's first match replaced, with the flag ``g`` all, with ``i`` blind to case; ``\1`` to ``\9`` stand for groups and ``\&`` for the match.

    For a first match the pattern may neither look around, name groups nor refer to them. ValueError for another flag.
    """
    if set(flags) - {"g", "i"}:
        raise ValueError(f"unknown flags {flags!r}")
    every, shift = "g" in flags, 0 if "g" in flags else 2
    if not every and _UNSHIFTED.search(pattern):
        raise ValueError("a first match can't be replaced by a pattern that looks around, names groups or refers to them")

    def meant(m: re.Match) -> str:
        if m[1] is None:
            return "\\" + m[0] if m[0] in "$\\0123456789" else m[0]  # a digit would lengthen a group's number
        if m[1] == "\\":
            return "\\\\"
        return f"${shift}" if m[1] == "&" else f"${int(m[1]) + shift}"

    to = re.sub(r"\\([1-9&\\])|[\s\S]", meant, text)
    blind = "(?i)" if "i" in flags else ""
    if every:
        return F.regexp_replace(_column(c), blind + pattern, to)
    return F.regexp_replace(_column(c), rf"{blind}\A([\s\S]*?)({pattern})", "$1" + to)


def format_text(template: str, *columns: str | Column) -> Column:
    """``%s`` a text, ``%I`` an identifier, in quotes where it needs them, ``%L`` a literal, ``%%``; ``%2$s`` names the second column. A null text is empty, a null literal NULL.

    ValueError for any other sign, or for a column that isn't there.
    """
    parts, at = [], 0
    for sign, place, kind, plain in re.findall(r"(%(?:(\d+)\$)?([sIL%]))|([^%]+|%)", template):
        if not sign:
            if plain == "%":
                raise ValueError(f"unknown sign in {template!r}")
            parts.append(F.lit(plain))
        elif kind == "%":
            parts.append(F.lit("%"))
        else:
            at = int(place) if place else at + 1
            if not 1 <= at <= len(columns):
                raise ValueError(f"no column {at} for {template!r}")
            c = _column(columns[at - 1]).cast("string")
            quoted = lambda q, c=c: F.concat(F.lit(q), F.replace(c, F.lit(q), F.lit(q * 2)), F.lit(q))
            if kind == "I":
                parts.append(F.when(c.isNull(), F.raise_error(F.lit("null as an identifier")).cast("string")).when(c.rlike("^[a-z_][a-z0-9_]*$"), c).otherwise(quoted('"')))
            else:
                parts.append(F.coalesce(c, F.lit("")) if kind == "s" else F.coalesce(quoted("'"), F.lit("NULL")))
    return F.concat(*parts) if parts else F.lit("")


def json_build_array(*columns: str | Column) -> Column:
    """A JSON array of values, nulls too."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_value(_column(c)) for c in columns)), F.lit("]"))


def json_build_object(*pairs: tuple[str, str | Column]) -> Column:
    """A JSON object of keys and values in the order given, nulls too."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(json_value(F.lit(k)), F.lit(":"), json_value(_column(c))) for k, c in pairs)), F.lit("}"))
