"""Format models of the source databases, compiled to Spark SQL: TO_CHAR, TO_DATE, TO_TIMESTAMP and TO_NUMBER.

A model is read into elements, the longest that fits first; what is no element, separator or quoted text is an error. The results are
SQL texts over a column or argument, so that they serve in DataFrames and as bodies of SQL functions, and run without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of dates: SQL of the text with its leading zeros or blanks, and without. {x} stands for the value.
_NUMBER = "CAST({} AS STRING)"


def _digits(value: str, width: int) -> tuple[str, str]:
    return f"lpad(CAST({value} AS STRING), {width}, '0')", f"CAST({value} AS STRING)"


def _part(pattern: str, width: int) -> tuple[str, str]:
    return f"date_format({{x}}, '{pattern}')", f"CAST(CAST(date_format({{x}}, '{pattern}') AS BIGINT) AS STRING)" if width else f"date_format({{x}}, '{pattern}')"


_HALF = "IF(hour({x}) < 12, '{am}', '{pm}')"
_SECONDS = "(hour({x}) * 3600 + minute({x}) * 60 + second({x}))"
_ISO = "extract(YEAROFWEEK FROM {x})"
DATE_ELEMENTS: dict[str, tuple[str, str]] = {
    "YYYY": _digits("year({x})", 4), "YYY": _digits("year({x}) % 1000", 3), "YY": _digits("year({x}) % 100", 2), "Y": _digits("year({x}) % 10", 1),
    "RRRR": _digits("year({x})", 4), "RR": _digits("year({x}) % 100", 2), "IYYY": _digits(_ISO, 4), "IYY": _digits(f"{_ISO} % 1000", 3), "IY": _digits(f"{_ISO} % 100", 2), "I": _digits(f"{_ISO} % 10", 1),
    "Y,YYY": ("concat(CAST(year({x}) div 1000 AS STRING), ',', lpad(CAST(year({x}) % 1000 AS STRING), 3, '0'))",) * 2,
    "CC": _digits("((year({x}) + 99) div 100)", 2), "Q": _digits("quarter({x})", 1), "MM": _digits("month({x})", 2), "WW": _digits("((dayofyear({x}) + 6) div 7)", 2),
    "W": _digits("((day({x}) + 6) div 7)", 1), "IW": _digits("weekofyear({x})", 2), "DDD": _digits("dayofyear({x})", 3), "DD": _digits("day({x})", 2), "D": _digits("dayofweek({x})", 1),
    "J": _digits("(unix_date(CAST({x} AS DATE)) + 2440588)", 7), "HH24": _digits("hour({x})", 2), "HH12": _digits("((hour({x}) + 11) % 12 + 1)", 2), "HH": _digits("((hour({x}) + 11) % 12 + 1)", 2),
    "MI": _digits("minute({x})", 2), "SSSSS": _digits(_SECONDS, 5), "SS": _digits("second({x})", 2), "MS": _part("SSS", 0), "US": _part("SSSSSS", 0), "FF": _part("SSSSSS", 0),
    **{f"FF{n}": (f"rpad(date_format({{x}}, '{'S' * min(n, 6)}'), {n}, '0')",) * 2 for n in range(1, 10)},
    "RM": ("rpad(element_at(array('I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'), month({x})), 4)", "element_at(array('I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'), month({x}))"),
    "MONTH": ("rpad(date_format({x}, 'MMMM'), 9)", "date_format({x}, 'MMMM')"), "MON": ("date_format({x}, 'MMM')",) * 2,
    "DAY": ("rpad(date_format({x}, 'EEEE'), 9)", "date_format({x}, 'EEEE')"), "DY": ("date_format({x}, 'EEE')",) * 2,
    **{k: (_HALF.replace("{am}", am).replace("{pm}", pm),) * 2 for k, am, pm in (("AM", "AM", "PM"), ("PM", "AM", "PM"), ("A.M.", "A.M.", "P.M."), ("P.M.", "A.M.", "P.M."))},
    **{k: ("IF(year({x}) > 0, 'AD', 'BC')",) * 2 for k in ("AD", "BC")},
}
#: Elements whose case in the model is that of the text.
NAMES = ("MONTH", "MON", "DAY", "DY", "RM", "AM", "PM", "A.M.", "P.M.", "AD", "BC")
_SEPARATOR = re.compile(r"[^A-Za-z0-9\"]")


def read_model(model: str, elements: dict | tuple) -> list[tuple[str, str]]:
    """(kind, text) of each part of a model: element, text, or FM, FX and TH."""
    out, at, known = [], 0, sorted([*elements, "FM", "FX", "TH"], key=len, reverse=True)
    while at < len(model):
        if model[at] == '"':
            stop = model.find('"', at + 1)
            if stop < 0:
                raise ValueError(f"a quoted text of the format model {model!r} does not end")
            out.append(("text", model[at + 1 : stop]))
            at = stop + 1
            continue
        found = next((k for k in known if model[at : at + len(k)].upper() == k), None)
        if found in ("FM", "FX", "TH"):
            out.append((found, model[at : at + 2]))
        elif found:
            out.append(("element", model[at : at + len(found)]))
        elif _SEPARATOR.match(model[at]):
            out.append(("text", model[at]))
        else:
            raise ValueError(f"unknown element at {model[at:]!r} of the format model {model!r}")
        at += len(found) if found else 1
    return out


def quoted(text: str) -> str:
    """A SQL literal, in which backslashes stand for themselves."""
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in text.split("'")) + ")" if "'" in text else f"r'{text}'"


def _cased(sql: str, spelt: str) -> str:
    if spelt.upper() not in NAMES:
        return sql
    if spelt[0].islower():
        return f"lower({sql})"
    return f"initcap({sql})" if len(spelt) > 1 and spelt[1].islower() else f"upper({sql})"


def _ordinal(sql: str, spelt: str) -> str:
    last, tens = f"CAST({sql} AS BIGINT) % 10", f"CAST({sql} AS BIGINT) % 100 div 10"
    ends = f"CASE WHEN {tens} = 1 THEN 'th' WHEN {last} = 1 THEN 'st' WHEN {last} = 2 THEN 'nd' WHEN {last} = 3 THEN 'rd' ELSE 'th' END"
    return f"concat({sql}, {f'upper({ends})' if spelt.isupper() else ends})"


def date_text_sql(x: str, model: str, engine: str = "oracle") -> str:
    """TO_CHAR of a date or timestamp. FM leaves out blanks and leading zeros: from there on, or (PostgreSQL) of the next element only."""
    parts, bare, out = read_model(model, DATE_ELEMENTS), False, []
    for kind, text in parts:
        if kind == "FM":
            bare = not bare or engine == "postgres"
        elif kind == "text":
            out.append(quoted(text))
        elif kind == "TH":
            if not out:
                raise ValueError(f"TH follows an element in {model!r}")
            out[-1] = _ordinal(out[-1], text)
        elif kind == "element":
            out.append(_cased(DATE_ELEMENTS[text.upper()][bare].replace("{x}", x), text))
            bare = bare and engine != "postgres"
    return f"concat({', '.join(out)})" if out else "''"


#: What elements of a date may be in a text, and which fields they give.
_READ = {
    "YYYY": (r"[0-9]{1,4}", "year"), "RRRR": (r"[0-9]{1,4}", "round"), "RR": (r"[0-9]{1,2}", "round"), "YY": (r"[0-9]{1,2}", "short"), "MM": (r"[0-9]{1,2}", "month"), "MONTH": (r"[A-Za-z]+", "name"), "MON": (r"[A-Za-z]{3}", "name"),
    "DDD": (r"[0-9]{1,3}", "day_of_year"), "DD": (r"[0-9]{1,2}", "day"), "HH24": (r"[0-9]{1,2}", "hour"), "HH12": (r"[0-9]{1,2}", "hour12"), "HH": (r"[0-9]{1,2}", "hour12"), "MI": (r"[0-9]{1,2}", "minute"), "SSSSS": (r"[0-9]{1,5}", "seconds"),
    "SS": (r"[0-9]{1,2}", "second"), "FF": (r"[0-9]{1,9}", "fraction"), "MS": (r"[0-9]{1,3}", "fraction"), "US": (r"[0-9]{1,6}", "fraction"), **{f"FF{n}": (rf"[0-9]{{1,{n}}}", "fraction") for n in range(1, 10)},
    "J": (r"[0-9]{1,7}", "julian"), "DAY": (r"[A-Za-z]+", ""), "DY": (r"[A-Za-z]{3}", ""), **{k: (r"[AaPp]\.?[Mm]\.?", "half") for k in ("AM", "PM", "A.M.", "P.M.")},
}
_MONTHS = "array('jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec')"


def timestamp_sql(x: str, model: str, strict: bool = False) -> str:
    """TO_TIMESTAMP of a text. Separators may be any sign that is no letter or digit, or left out; blanks around names don't count.

    What the model lacks is the first month, day or instant; a missing year is this one. A text that does not fit, or is no date, is null, or
    an error if ``strict``.
    """
    groups: dict[str, int] = {}
    pattern, n = r"^\s*", 0
    for kind, text in read_model(model, _READ):
        if kind == "text":
            pattern += r"\s*" if text.isspace() else "".join(r"[^A-Za-z0-9]?" if _SEPARATOR.match(c) else f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)
        elif kind == "element":
            expression, field = _READ[text.upper()]
            n += 1
            pattern += rf"({expression})" + (r"\s*" if text.upper() in ("MONTH", "DAY") else "")
            if field and field in groups:
                raise ValueError(f"the format model {model!r} has an element twice")
            groups[field] = n
    pattern += r"\s*$"
    get = lambda f: f"regexp_extract({x}, {quoted(pattern)}, {groups[f]})"
    number = lambda f: f"CAST(nullif({get(f)}, '') AS INT)"
    year = "year(current_date())"
    if "year" in groups:
        year = number("year")
    elif "short" in groups:
        year = f"(year(current_date()) div 100 * 100 + {number('short')})"
    elif "round" in groups:  # 50 to 99 are of the last century, others of this one
        y = number("round")
        year = f"(CASE WHEN {y} >= 100 THEN {y} WHEN {y} >= 50 THEN {y} + 1900 ELSE {y} + 2000 END)"
    month = number("month") if "month" in groups else f"nullif(array_position({_MONTHS}, lower(substr({get('name')}, 1, 3))), 0)" if "name" in groups else "1"
    day = number("day") if "day" in groups else "1"
    hour = number("hour") if "hour" in groups else "0"
    if "hour12" in groups:
        hour = f"({number('hour12')} % 12 + IF(lower({get('half')}) LIKE 'p%', 12, 0))" if "half" in groups else number("hour12")
    minute = number("minute") if "minute" in groups else "0"
    second = f"CAST({number('second')} AS DECIMAL(8, 6))" if "second" in groups else "CAST(0 AS DECIMAL(8, 6))"
    if "fraction" in groups:
        second = f"CAST({second} + CAST(concat('0.', substr({get('fraction')}, 1, 6)) AS DECIMAL(8, 6)) AS DECIMAL(8, 6))"
    made = f"try_make_timestamp_ntz({year}, CAST({month} AS INT), {day}, {hour}, {minute}, {second})"
    if "day_of_year" in groups:
        made = f"({made} + make_dt_interval({number('day_of_year')} - 1))"
    if "julian" in groups:
        made = f"(CAST(date_from_unix_date({number('julian')} - 2440588) AS TIMESTAMP_NTZ) + make_dt_interval(0, {hour}, {minute}, {second}))"
    if "seconds" in groups:
        made = f"({made} + make_dt_interval(0, 0, 0, {number('seconds')}))"
    out = f"CASE WHEN {x} RLIKE {quoted(pattern)} THEN {made} END"
    if not strict:
        return out
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce({out}, CAST(raise_error(concat('no date by the model ', {quoted(model)}, ': ', {x})) AS TIMESTAMP_NTZ)) END"


# ---------------------------------------------------------------- numbers

NUMBER_ELEMENTS = ("9", "0", ".", ",", "D", "G", "$", "L", "S", "MI", "PR")


class _NumberModel:
    """Digits of a model of numbers: positions before and after the point, separators, and how the sign is told."""

    def __init__(self, model: str) -> None:
        self.bare, self.dollar, self.sign = False, False, ""
        self.whole: list[str] = []  # 9, 0 or ',' from left to right
        self.fraction: list[str] = []
        point, parts = False, read_model(model, NUMBER_ELEMENTS)
        for i, (kind, text) in enumerate(parts):
            e = text.upper()
            if kind == "FM":
                self.bare = True
            elif kind != "element":
                raise ValueError(f"unknown element {text!r} of the number model {model!r}")
            elif e in ("9", "0"):
                (self.fraction if point else self.whole).append(e)
            elif e in (",", "G"):
                if point:
                    raise ValueError(f"a group separator after the point of {model!r}")
                self.whole.append(",")
            elif e in (".", "D"):
                if point:
                    raise ValueError(f"two points in {model!r}")
                point = True
            elif e in ("$", "L"):
                self.dollar = True
            elif self.sign or e in ("MI", "PR") and i != len(parts) - 1 or e == "S" and i not in (0, len(parts) - 1) and parts[i - 1][0] != "FM":
                raise ValueError(f"the sign of {model!r} is not at an end")
            else:
                self.sign = {"S": "S" if any(c in "90" for c in self.whole + self.fraction) else "s"}.get(e, e)  # s: before the digits
        self.point = point
        self.places = sum(c in "90" for c in self.whole)
        if not self.places and not self.fraction:
            raise ValueError(f"the number model {model!r} has no digits")


def number_text_sql(x: str, model: str) -> str:
    """TO_CHAR of a number: rounded to the model's places; a number that needs more digits than it has is shown as ``#``.

    Nines are blank before the first digit, zeros are not; separators come only between digits. Without a sign element the text has a column
    for it before the first digit. FM leaves out blanks, and zeros at the end where the model has nines.
    """
    m = _NumberModel(model)
    scale = len(m.fraction)
    value = f"round(CAST({x} AS DECIMAL(38, {max(scale + 2, 10)})), {scale})"
    units = f"CAST(abs({value}) AS DECIMAL(38, 0))" if not scale else f"CAST(floor(abs({value})) AS DECIMAL(38, 0))"
    digits = f"CASE WHEN {units} = 0 THEN '' ELSE CAST({units} AS STRING) END"
    forced = m.places - [c for c in m.whole if c != ","].index("0") if "0" in m.whole else 0  # digits that are shown at least
    if not scale and not forced:
        forced = 1
    shown = f"lpad({digits}, greatest(length({digits}), {forced}), '0')"
    if "," in m.whole:  # from the right: a separator after so many digits, if there are more
        parts, run = [], 0
        for c in reversed(m.whole):
            if c == ",":
                parts.append(run)
            else:
                run += 1
        ends = [0, *parts]
        pieces = [f"CASE WHEN length(s) > {b} THEN substr(s, greatest(length(s) - {e}, 0) + 1, least({e} - {b}, length(s) - {b})) END" for b, e in zip(ends, [*parts, m.places], strict=True) if e > b]
        shown = f"element_at(transform(array({shown}), s -> concat_ws(',', {', '.join(reversed(pieces))})), 1)"
    if m.point:
        part = f"lpad(CAST(CAST((abs({value}) - {units}) * {10**scale} AS DECIMAL(38, 0)) AS STRING), {scale}, '0')" if scale else "''"
        if m.bare and scale:
            kept = max((i + 1 for i, c in enumerate(m.fraction) if c == "0"), default=0)
            part = f"concat(substr({part}, 1, {kept}), regexp_replace(substr({part}, {kept + 1}), '0+$', ''))"
        shown = f"concat({shown}, '.', {part})"
    if m.dollar:
        shown = f"concat('$', {shown})"
    minus = f"{value} < 0"
    width = len(m.whole) + m.point + scale + m.dollar
    if m.sign == "S":
        body, total = f"concat({shown}, IF({minus}, '-', '+'))", width + 1
    elif m.sign == "MI":
        body, total = f"concat({shown}, IF({minus}, '-', '{'' if m.bare else ' '}'))", width + 1
    elif m.sign == "PR":
        body, total = f"IF({minus}, concat('<', {shown}, '>'), concat({'' if m.bare else chr(39) + ' ' + chr(39) + ', '}{shown}{'' if m.bare else ', ' + chr(39) + ' ' + chr(39)}))", width + 2
    elif m.sign == "s":
        body, total = f"concat(IF({minus}, '-', '+'), {shown})", width + 1
    else:
        body, total = f"concat(IF({minus}, '-', '{'' if m.bare else ' '}'), {shown})", width + 1
    if not m.bare:
        body = f"lpad({body}, {total})"
    return f"CASE WHEN {x} IS NOT NULL THEN IF(length({digits}) > {m.places}, repeat('#', {total}), {body}) END"


def number_sql(x: str, model: str, strict: bool = False) -> str:
    """TO_NUMBER of a text, as a decimal; a text with more digits than the model, or other signs, is null, or an error if ``strict``."""
    m = _NumberModel(model)
    digits = f"[0-9,]{{0,{len(m.whole)}}}" if "," in m.whole else f"[0-9]{{0,{m.places}}}"
    fraction = rf"(?:\.[0-9]{{0,{len(m.fraction)}}})?" if m.point else ""
    dollar = r"\$?" if m.dollar else ""
    body = f"{dollar}{digits}{fraction}"
    before = {"S": "", "MI": "", "PR": "<?", "s": "[+-]?"}.get(m.sign, "-?")
    after = {"S": "[+-]?", "MI": "-?", "PR": ">?"}.get(m.sign, "")
    pattern = rf"^\s*{before}{body}{after}\s*$"
    kind = f"DECIMAL(38, {len(m.fraction)})"
    plain = f"regexp_replace({x}, '[^0-9.]', '')"
    negative = f"{x} RLIKE '[-<]'"
    out = f"CASE WHEN {x} RLIKE {quoted(pattern)} AND {x} RLIKE '[0-9]' THEN CAST(IF({negative}, -1, 1) * CAST({plain} AS {kind}) AS {kind}) END"
    if not strict:
        return out
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce({out}, CAST(raise_error(concat('no number by the model ', {quoted(model)}, ': ', {x})) AS {kind})) END"


def _columns(make: Callable[..., str]) -> Callable[..., Column]:
    def use(column: str, model: str, **options) -> Column:
        return F.expr(make(f"`{column}`", model, **options)).alias(f"{make.__name__.removesuffix('_sql')}({column}, {model})")

    use.__doc__ = make.__doc__
    return use


to_char_date = _columns(date_text_sql)
to_char_number = _columns(number_text_sql)
to_timestamp = _columns(timestamp_sql)
to_number = _columns(number_sql)


def to_date(column: str, model: str, strict: bool = False) -> Column:
    """TO_DATE of a text: the day of its timestamp."""
    return to_timestamp(column, model, strict=strict).cast("date")


#: SQL functions that a model makes: argument and result types, and the text.
MODEL_FUNCTIONS = {"to_char_date": ("TIMESTAMP_NTZ", "STRING", date_text_sql), "to_char_number": ("DECIMAL(38, 10)", "STRING", number_text_sql), "to_timestamp": ("STRING", "TIMESTAMP_NTZ", timestamp_sql), "to_number": ("STRING", "DECIMAL(38, 10)", number_sql)}


def register_models(spark, models: dict[str, tuple[str, str]]) -> list[str]:
    """SQL functions of one argument, by name: each a kind of MODEL_FUNCTIONS and its model."""
    for name, (kind, model) in models.items():
        argument, result, make = MODEL_FUNCTIONS[kind]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x {argument}) RETURNS {result} RETURN {make('x', model)}")
    return list(models)
