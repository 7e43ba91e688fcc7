"""Queries of the source databases' functions: format models, dates and intervals, JSON, numbers and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe import functions
from driftframe.functions import formats, json_values, texts
from driftframe.plans.registry import bound

_TIME = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


def _formats(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    shown = rows.select(
        "*", formats.to_char_date("o_orderdate", "YYYY-MM-DD HH24:MI:SS").alias("shown"), formats.to_char_date("o_orderdate", "FMDay, DD Mon YYYY").alias("named"), formats.to_char_date("o_orderdate", 'DDD/Q/D "W"WW').alias("parts"),
        formats.to_char_date("o_orderdate", "HH12:MI am", engine="postgres").alias("half"), formats.to_char_date("o_orderdate", "DD-MON-RR SSSSS").alias("short"), formats.to_char_number("price", "FM999,999,990.00").alias("money"), formats.to_char_number("price", "S9G999G990D00").alias("wide"),
    )
    return shown.select(
        "o_orderkey", "shown", "named", "parts", "half", "short", "money", "wide", (formats.to_timestamp("shown", "YYYY-MM-DD HH24:MI:SS", strict=True) == F.col("o_orderdate")).alias("same"), formats.to_timestamp("short", "DD-MON-RR SSSSS").alias("back"),
        formats.to_date("named", "DAY, DD MON YYYY").alias("day"), formats.to_number("wide", "S9G999G990D00").cast("double").alias("number"),
    )


bound(
    "sf5",
    _formats,
    "orders",
    f"""SELECT o_orderkey, {_TIME} AS shown, strftime(o_orderdate, '%A, %-d %b %Y') AS named, concat(strftime(o_orderdate, '%j'), '/', quarter(o_orderdate), '/', dayofweek(o_orderdate) + 1, ' W', lpad(CAST((dayofyear(o_orderdate) + 6) // 7 AS VARCHAR), 2, '0')) AS parts,
 lower(strftime(o_orderdate, '%I:%M %p')) AS half, concat(upper(strftime(o_orderdate, '%d-%b-%y')), ' ', lpad(CAST(epoch(o_orderdate)::BIGINT % 86400 AS VARCHAR), 5, '0')) AS short, format('{{:,.2f}}', o_totalprice) AS money, lpad(format('+{{:,.2f}}', o_totalprice), 13, ' ') AS wide,
 true AS same, date_trunc('second', o_orderdate) AS back, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS number FROM orders""",
)


def _with_functions(df: DataFrame) -> DataFrame:
    functions.register(df.sparkSession)
    return df


_FIXED = "timestamp_ntz'2024-02-29 06:00:00'"
bound(
    "sf13",
    lambda o: _with_functions(o).selectExpr(
        "o_orderkey", "ora_add_months(o_orderdate, 2) AS later", "ora_add_months(ora_last_day(o_orderdate), -3) AS month_end", "ora_last_day(o_orderdate) AS last", f"round(ora_months_between(o_orderdate, {_FIXED}), 6) AS months", f"ora_months_between(ora_last_day(o_orderdate), {_FIXED}) AS whole",
        "ora_next_day(o_orderdate, 'FRIDAY') AS friday", "o_orderdate + ora_to_dsinterval(concat('-', o_orderkey % 9, ' 01:02:0', o_orderkey % 7, '.5')) AS before", "o_orderdate + ora_numtodsinterval(o_orderkey % 5 / 2, 'hour') AS after", "o_orderdate + ora_to_yminterval(concat(o_orderkey % 3, '-', '05')) AS years", "o_orderdate + ora_numtoyminterval(o_orderkey % 4, 'MONTH') AS quarter",
        "CAST(ora_from_tz(o_orderdate, '+05:30') AS TIMESTAMP_NTZ) AS utc", "ora_sys_extract_utc(ora_from_tz(o_orderdate, '-02:00')) AS extracted", "ora_bitand(o_orderkey, 7) AS ba", "remainder_number(o_orderkey, 7) AS rest",
    ),
    "orders",
    """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 2 MONTH) + CAST(o_orderdate AS TIME) ELSE o_orderdate + INTERVAL 2 MONTH END AS later,
 last_day(last_day(o_orderdate) - INTERVAL 3 MONTH) + CAST(o_orderdate AS TIME) AS month_end, last_day(o_orderdate) + CAST(o_orderdate AS TIME) AS last,
 round(CASE WHEN day(o_orderdate) = 29 OR CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN m ELSE m + (day(o_orderdate) - 29 + (epoch(o_orderdate) % 86400 - 21600) / 86400.0) / 31.0 END, 6) AS months, CAST(m AS DOUBLE) AS whole,
 o_orderdate + to_days(CAST(1 + (11 - isodow(o_orderdate)) % 7 AS INT)) AS friday, o_orderdate - to_days(CAST(o_orderkey % 9 AS INT)) - INTERVAL '1 hour 2 minutes' - to_milliseconds(CAST((o_orderkey % 7) * 1000 + 500 AS BIGINT)) AS before, o_orderdate + to_minutes(CAST(o_orderkey % 5 * 30 AS BIGINT)) AS after,
 o_orderdate + to_months(CAST(o_orderkey % 3 * 12 + 5 AS INT)) AS years, o_orderdate + to_months(CAST(o_orderkey % 4 AS INT)) AS quarter, o_orderdate - INTERVAL 330 MINUTE AS utc, o_orderdate + INTERVAL 2 HOUR AS extracted, o_orderkey & 7 AS ba, CAST(CASE WHEN o_orderkey % 7 > 3 THEN o_orderkey % 7 - 7 ELSE o_orderkey % 7 END AS DOUBLE) AS rest
 FROM (SELECT *, year(o_orderdate) * 12 + month(o_orderdate) - 24290 AS m FROM orders) o""",
)
bound(
    "sf19",
    lambda e: _with_functions(e).selectExpr(
        "event_id", "date_trunc('hour', ts) AS h", "pg_date_bin(INTERVAL '15' MINUTE, ts, timestamp_ntz'2024-01-01 00:05:00') AS bin", "pg_date_bin(INTERVAL '1 06:00:00' DAY TO SECOND, ts, timestamp_ntz'2025-01-01 00:00:00') AS days",
        "pg_age(timestamp_ntz'2024-03-10 12:00:00', ts) AS age", "pg_age(ts, timestamp_ntz'2024-03-10 12:00:00') AS until", "pg_date_part('dow', ts) AS dow", "pg_date_part('isodow', ts) AS isodow", "pg_date_part('doy', ts) AS doy", "round(pg_date_part('epoch', ts), 3) AS epoch",
        "make_date(2024, 1, CAST(1 + event_id % 28 AS INT)) AS md", "make_timestamp_ntz(2024, 2, 3, CAST(event_id % 24 AS INT), 5, 6.5) AS mt", "ts + pg_make_interval(1, CAST(event_id % 5 AS INT)) AS next", "pg_isfinite(ts) AS fin", "now() IS NOT NULL AND current_time() IS NOT NULL AS n",
    ).select("*", "age.months", F.expr("unix_micros(CAST(timestamp_ntz'1970-01-01 00:00:00' + age.rest AS TIMESTAMP))").alias("rest"), F.col("until.months").alias("back")).drop("age", "until"),
    "events",
    """SELECT event_id, date_trunc('hour', ts) AS h, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2024-01-01 00:05:00') AS bin, time_bucket(INTERVAL '30 hours', ts, TIMESTAMP '2025-01-01 00:00:00') AS days,
 CAST(dayofweek(ts) AS DOUBLE) AS dow, CAST(isodow(ts) AS DOUBLE) AS isodow, CAST(dayofyear(ts) AS DOUBLE) AS doy, round(epoch(ts), 3) AS epoch, make_date(2024, 1, CAST(1 + event_id % 28 AS INT)) AS md, make_timestamp(2024, 2, 3, event_id % 24, 5, 6.5) AS mt,
 ts + to_months(CAST(12 + event_id % 5 AS INT)) AS next, true AS fin, true AS n, CAST(date_part('year', a) * 12 + date_part('month', a) AS INT) AS months, CAST(date_part('day', a) * 86400000000 + epoch_us(a - to_months(CAST(date_part('year', a) * 12 + date_part('month', a) AS INT)) - to_days(CAST(date_part('day', a) AS INT))) AS BIGINT) AS rest,
 -CAST(date_part('year', a) * 12 + date_part('month', a) AS INT) AS back FROM (SELECT *, age(TIMESTAMP '2024-03-10 12:00:00', ts) AS a FROM events) e""",
)
_DOCUMENT = "concat('{ \"id\": ', event_id, ', \"gone\": null, \"in\": {\"z\": null, \"list\": [null, {\"y\": null}, ', event_id % 7, ']}, \"text\": \"a:null, }\", \"props\": ', props, ', \"last\": null }')"
bound(
    "sf15",
    lambda e: _with_functions(e).selectExpr("event_id", f"{_DOCUMENT} AS j").selectExpr(
        "event_id", "ora_json_value(j, '$.id') AS v", "ora_json_value(j, '$.in') AS none", "ora_json_query(j, '$.in.list') AS q", "ora_json_query(j, '$.text') AS scalar", "ora_json_query(j, '$.props') AS p", "ora_json_exists(j, '$.props.k') AS ex", "ora_json_exists(j, '$.props.zz') AS nx", "to_json(named_struct('id', event_id, 'list', array(1, 2))) AS obj",
    ),
    "events",
    """SELECT event_id, CAST(event_id AS VARCHAR) AS v, NULL AS none, concat('[null,{"y":null},', event_id % 7, ']') AS q, NULL AS scalar, replace(props, ' ', '') AS p, json_exists(props, '$.k') AS ex, false AS nx, concat('{"id":', event_id, ',"list":[1,2]}') AS obj FROM events""",
)
bound(
    "sf15_agg",
    lambda e: e.groupBy("user_id").agg(json_values.json_arrayagg("event_type", "event_id").alias("types"), json_values.json_arrayagg(F.when(F.col("event_type") != "error", F.col("event_id")), "ts", "event_id").alias("ids"), json_values.json_objectagg("event_id", "event_type").alias("obj")),
    "events",
    """SELECT user_id, concat('[', string_agg(concat('"', event_type, '"'), ',' ORDER BY event_id), ']') AS types, concat('[', coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FILTER (event_type <> 'error'), ''), ']') AS ids,
 concat('{', string_agg(concat('"', event_id, '":"', event_type, '"'), ',' ORDER BY concat('"', event_id, '"')), '}') AS obj FROM events GROUP BY user_id""",
)
bound(
    "sf21",
    lambda e: _with_functions(e).selectExpr("event_id", "user_id", "props", f"{_DOCUMENT} AS j").selectExpr(
        "event_id", "pg_json_strip_nulls(j) AS stripped", "pg_json_typeof(j) AS kind", "pg_json_typeof(pg_json_extract_path_text(j, array('in', 'list'))) AS list_kind", "pg_json_typeof(pg_json_extract_path_text(j, array('in', 'list', '2'))) AS number_kind", "pg_json_extract_path_text(j, array('in', 'list', '2')) AS third",
        "pg_json_array_length(pg_json_extract_path_text(j, array('in', 'list'))) AS n", "pg_json_typeof(substr(j, 2)) AS bad", "regexp_replace(pg_jsonb_pretty(props), '\\\\s', '') AS pretty", "to_json(named_struct('k', user_id, 'none', CAST(NULL AS INT))) AS obj",
    ),
    "events",
    """SELECT event_id, concat('{"id":', event_id, ',"in":{"list":[null,{},', event_id % 7, ']},"text":"a:null, }","props":', replace(props, ' ', ''), '}') AS stripped, 'object' AS kind, 'array' AS list_kind, 'number' AS number_kind, CAST(event_id % 7 AS VARCHAR) AS third,
 3 AS n, NULL AS bad, replace(props, ' ', '') AS pretty, concat('{"k":', user_id, '}') AS obj FROM events""",
)
bound(
    "ud3",
    lambda o: _with_functions(o).selectExpr(
        "o_orderkey", "trunc_number(o_totalprice / 100, 0) AS hundreds", "trunc_number(-o_totalprice, 1) AS tenths", "trunc_number(o_totalprice, -2) AS rounded", "trunc_number(2.9999999999D - o_orderkey % 2, 0) AS below", "nanvl_number(IF(o_orderkey % 3 = 0, double('NaN'), 1.0D), 0.0D) AS filled",
        "remainder_number(o_orderkey, 7) AS rest", "instr_from(o_orderpriority, 'I', 2, 1) AS place", "to_number_text(concat(' $', o_custkey, ',000 ')) AS number", "nvl2_text(nullif(o_orderstatus, 'F'), 'open', 'done') AS state", "pg_scale(CAST(CAST(o_totalprice AS DECIMAL(12, 3)) AS STRING)) AS sc", "pg_to_hex(o_custkey) AS hex",
        "pg_num_nulls(array(nullif(o_orderstatus, 'F'), o_orderpriority, NULL)) AS nulls", "pg_array_position(split(o_orderpriority, '-'), 'LOW') AS low", "ora_concat(nullif(o_orderstatus, 'O'), '!') AS said", "ora_greatest(o_orderkey, nullif(o_custkey, 5)) AS most", "ora_regexp_instr(o_orderpriority, '[A-Z]') AS letter",
    ),
    "orders",
    """SELECT o_orderkey, CAST(cents // 10000 AS DOUBLE) AS hundreds, -(cents // 10) / 10.0 AS tenths, CAST(cents // 10000 * 100 AS DOUBLE) AS rounded, 2.0 - o_orderkey % 2 AS below,
 CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 1.0 END AS filled, CAST(CASE WHEN o_orderkey % 7 > 3 THEN o_orderkey % 7 - 7 ELSE o_orderkey % 7 END AS DOUBLE) AS rest, CASE WHEN contains(substr(o_orderpriority, 2), 'I') THEN position('I' IN substr(o_orderpriority, 2)) + 1 ELSE 0 END AS place, CAST(o_custkey * 1000 AS DOUBLE) AS number,
 CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, 3 AS sc, lower(hex(o_custkey)) AS hex, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS nulls, nullif(list_position(string_split(o_orderpriority, '-'), 'LOW'), 0) AS low, concat(CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END, '!') AS said,
 CASE WHEN o_custkey <> 5 THEN CAST(greatest(o_orderkey, o_custkey) AS DOUBLE) END AS most, strpos(o_orderpriority, regexp_extract(o_orderpriority, '[A-Z]')) AS letter FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o""",
)


def _texts(customers: DataFrame) -> DataFrame:
    rows = _with_functions(customers).withColumns({"address": F.concat(F.lower("c_mktsegment"), F.lit("-"), F.lower("c_name")), "none": F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))})
    return rows.select(
        "c_custkey", F.expr("initcap_words(address)").alias("words"), F.expr("ora_substr(c_name, -4, 2)").alias("tail"), F.expr("pg_substring(c_name, -1, 5)").alias("clipped"), F.expr("ora_instr(address, 'e', -1, 1)").alias("last_e"), F.expr("ora_instr(address, 'e', 1, 2)").alias("second_e"),
        F.expr("pg_array_to_string(pg_string_to_array(address, '#', 'x'), '|', '*')").alias("joined"), F.expr("pg_array_length(pg_string_to_array(c_name, NULL, NULL), 1)").alias("n"), F.expr("bucket_number(c_acctbal, -500, 9000, 7)").alias("bucket"), F.expr("pg_div(c_acctbal, 100)").alias("hundreds"),
        texts.concat_present("none", F.lit("/"), "c_nationkey").alias("both"), F.round(texts.ratio_to_report("c_custkey", "c_nationkey"), 9).alias("part"), F.array_join(texts.regexp_match("c_name", "([A-Z])[a-z]+#0*([1-9])"), ",").alias("groups"),
        texts.regexp_replace("c_name", "(0)([0-9])", r"<\2\1>").alias("once"), texts.regexp_replace("c_name", "0+", r"[\&]", "g").alias("every"), texts.format_text("%s is %I, %2$L or %3$L; 5%%", "c_custkey", "c_name", "none").alias("said"), texts.json_build_object(("id", "c_custkey"), ("no", "none")).alias("object"), texts.json_build_array("c_custkey", "none").alias("list"),
    )


_LITERAL = "coalesce(chr(39) || {} || chr(39), 'NULL')"
_QUOTED = "coalesce(chr(34) || none || chr(34), 'null')"
bound(
    "sf17_texts",
    _texts,
    "customer",
    f"""
SELECT c_custkey, concat(upper(substr(s, 1, 1)), substr(s, 2), '-', upper(substr(m, 1, 1)), substr(m, 2)) AS words, substr(c_name, length(c_name) - 3, 2) AS tail, substr(c_name, 1, 3) AS clipped, length(a) - strpos(reverse(a), 'e') + 1 AS last_e,
 CASE WHEN strpos(substr(a, strpos(a, 'e') + 1), 'e') = 0 THEN 0 ELSE strpos(a, 'e') + strpos(substr(a, strpos(a, 'e') + 1), 'e') END AS second_e, replace(a, '#', '|') AS joined, length(c_name) AS n,
 CASE WHEN c_acctbal < -500 THEN 0 WHEN c_acctbal >= 9000 THEN 8 ELSE CAST(floor((c_acctbal + 500) / 9500 * 7) AS INT) + 1 END AS bucket, trunc(c_acctbal / 100) + 0.0 AS hundreds, concat(none, '/', c_nationkey) AS both, round(c_custkey / sum(c_custkey) OVER (PARTITION BY c_nationkey), 9) AS part,
 CASE WHEN regexp_matches(c_name, '([A-Z])[a-z]+#0*([1-9])') THEN concat(regexp_extract(c_name, '([A-Z])[a-z]+#0*([1-9])', 1), ',', regexp_extract(c_name, '([A-Z])[a-z]+#0*([1-9])', 2)) END AS groups, regexp_replace(c_name, '(0)([0-9])', '<\\2\\1>') AS once, regexp_replace(c_name, '0+', '[\\0]', 'g') AS every,
 concat(c_custkey, ' is "', c_name, '", ', {_LITERAL.format('c_name')}, ' or ', {_LITERAL.format('none')}, '; 5%') AS said, concat('{{"id":', c_custkey, ',"no":', {_QUOTED}, '}}') AS object, concat('[', c_custkey, ',', {_QUOTED}, ']') AS list
FROM (SELECT *, lower(c_mktsegment) AS s, lower(c_name) AS m, concat(lower(c_mktsegment), '-', lower(c_name)) AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS none FROM customer) c""",
)
