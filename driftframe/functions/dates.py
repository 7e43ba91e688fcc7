"""Dates and intervals of the source databases as SQL functions: month arithmetic, intervals, zones, bins and ages."""

from __future__ import annotations

_DAYS = {1: "SUN", 2: "MON", 3: "TUE", 4: "WED", 5: "THU", 6: "FRI", 7: "SAT"}
_LAST = "day(last_day(CAST({0} AS DATE)))"
_TIME = "({0} - CAST(CAST({0} AS DATE) AS TIMESTAMP_NTZ))"
_SECONDS = "(unix_micros(CAST({0} AS TIMESTAMP)) - unix_micros(CAST({1} AS TIMESTAMP)))"
_MONTHS = "(year(a) * 12 + month(a) - year(b) * 12 - month(b))"
#: a's fields less b's, for a at or after b: a missing time is taken from the days, missing days are those of b's month, then a month less.
_CLOCK = "(unix_micros(CAST(hi AS TIMESTAMP)) % 86400000000 - unix_micros(CAST(lo AS TIMESTAMP)) % 86400000000)"
_BORROWED = f"IF({_CLOCK} < 0, 1, 0)"
_AGE_DAYS = f"(day(hi) - day(lo) - {_BORROWED})"
_AGE_MONTHS = f"(year(hi) * 12 + month(hi) - year(lo) * 12 - month(lo) - IF({_AGE_DAYS} < 0, 1, 0))"
_AGE_REST = f"make_dt_interval(IF({_AGE_DAYS} < 0, {_AGE_DAYS} + {_LAST.format('lo')}, {_AGE_DAYS}), 0, 0, CAST((({_CLOCK}) + 86400000000) % 86400000000 / 1000000 AS DECIMAL(18, 6)))"
_DS = r"r'^\s*([+-]?)([0-9]{1,9})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]{1,9})?)\s*$'"
_YM = r"r'^\s*([+-]?)([0-9]{1,9})-([0-9]{1,2})\s*$'"
_get = lambda pattern, n, kind="INT": f"CAST(nullif(regexp_extract(s, {pattern}, {n}), '') AS {kind})"

#: Name, arguments, result and body of each.
FUNCTIONS = (
    # the last day of a month stays the last day
    ("ora_add_months", "d TIMESTAMP_NTZ, n INT", "TIMESTAMP_NTZ", f"CAST(IF(day(d) = {_LAST.format('d')}, last_day(add_months(CAST(d AS DATE), n)), add_months(CAST(d AS DATE), n)) AS TIMESTAMP_NTZ) + {_TIME.format('d')}"),
    ("ora_last_day", "d TIMESTAMP_NTZ", "TIMESTAMP_NTZ", f"CAST(last_day(CAST(d AS DATE)) AS TIMESTAMP_NTZ) + {_TIME.format('d')}"),
    # whole months where the days are the same or both the last, else parts of 31 days
    ("ora_months_between", "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "DOUBLE", f"IF(day(a) = day(b) OR day(a) = {_LAST.format('a')} AND day(b) = {_LAST.format('b')}, CAST({_MONTHS} AS DOUBLE), {_MONTHS} + (day(a) - day(b) + (unix_micros(CAST(a AS TIMESTAMP)) % 86400000000 - unix_micros(CAST(b AS TIMESTAMP)) % 86400000000) / 86400000000D) / 31D)"),
    ("ora_next_day", "d TIMESTAMP_NTZ, name STRING", "TIMESTAMP_NTZ", f"CAST(next_day(CAST(d AS DATE), name) AS TIMESTAMP_NTZ) + {_TIME.format('d')}"),
    ("ora_to_dsinterval", "s STRING", "INTERVAL DAY TO SECOND", f"IF(regexp_extract(s, {_DS}, 1) = '-', -1, 1) * make_dt_interval({_get(_DS, 2)}, {_get(_DS, 3)}, {_get(_DS, 4)}, {_get(_DS, 5, 'DECIMAL(18, 6)')})"),
    ("ora_to_yminterval", "s STRING", "INTERVAL YEAR TO MONTH", f"IF(regexp_extract(s, {_YM}, 1) = '-', -1, 1) * make_ym_interval({_get(_YM, 2)}, {_get(_YM, 3)})"),
    ("ora_numtodsinterval", "n DOUBLE, unit STRING", "INTERVAL DAY TO SECOND", "make_dt_interval(0, 0, 0, CAST(round(n * element_at(map('DAY', 86400D, 'HOUR', 3600D, 'MINUTE', 60D, 'SECOND', 1D), upper(trim(unit))), 6) AS DECIMAL(18, 6)))"),
    ("ora_numtoyminterval", "n DOUBLE, unit STRING", "INTERVAL YEAR TO MONTH", "make_ym_interval(0, CAST(round(n * element_at(map('YEAR', 12D, 'MONTH', 1D), upper(trim(unit)))) AS INT))"),
    ("ora_from_tz", "ts TIMESTAMP_NTZ, tz STRING", "TIMESTAMP", "CAST(convert_timezone(tz, current_timezone(), ts) AS TIMESTAMP)"),
    ("ora_sys_extract_utc", "ts TIMESTAMP", "TIMESTAMP_NTZ", "convert_timezone(current_timezone(), 'UTC', CAST(ts AS TIMESTAMP_NTZ))"),
    ("ora_bitand", "a BIGINT, b BIGINT", "BIGINT", "a & b"),
    ("pg_date_bin", "stride INTERVAL DAY TO SECOND, ts TIMESTAMP_NTZ, origin TIMESTAMP_NTZ", "TIMESTAMP_NTZ", f"origin + stride * CAST(floor({_SECONDS.format('ts', 'origin')} / CAST(extract(DAY FROM stride) * 86400000000 + extract(HOUR FROM stride) * 3600000000 + extract(MINUTE FROM stride) * 60000000 + extract(SECOND FROM stride) * 1000000 AS DECIMAL(38, 0))) AS BIGINT)"),
    ("pg_age_parts", "hi TIMESTAMP_NTZ, lo TIMESTAMP_NTZ", "STRUCT<months: INT, rest: INTERVAL DAY TO SECOND>", f"named_struct('months', {_AGE_MONTHS}, 'rest', {_AGE_REST})"),
    # years and months, and days with a time, both negative where a is before b
    ("pg_age", "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "STRUCT<months: INT, rest: INTERVAL DAY TO SECOND>", "CASE WHEN a >= b THEN pg_age_parts(a, b) WHEN a < b THEN named_struct('months', -pg_age_parts(b, a).months, 'rest', -pg_age_parts(b, a).rest) END"),
    ("pg_isfinite", "ts TIMESTAMP_NTZ", "BOOLEAN", "IF(ts IS NULL, NULL, true)"),
    ("pg_date_part", "field STRING, ts TIMESTAMP_NTZ", "DOUBLE", "CASE lower(field) WHEN 'dow' THEN dayofweek(ts) - 1D WHEN 'isodow' THEN (dayofweek(ts) + 5) % 7 + 1D WHEN 'doy' THEN dayofyear(ts) WHEN 'epoch' THEN unix_micros(CAST(ts AS TIMESTAMP)) / 1000000D WHEN 'quarter' THEN quarter(ts) WHEN 'week' THEN weekofyear(ts) WHEN 'year' THEN year(ts) WHEN 'month' THEN month(ts) WHEN 'day' THEN day(ts) WHEN 'hour' THEN hour(ts) WHEN 'minute' THEN minute(ts) WHEN 'second' THEN CAST(extract(SECOND FROM ts) AS DOUBLE) END"),
    ("pg_make_interval", "years INT, months INT", "INTERVAL YEAR TO MONTH", "make_ym_interval(years, months)"),
)
