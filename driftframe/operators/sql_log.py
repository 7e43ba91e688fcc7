"""Screening of logged SQL: what a read-only query must not hold.

Comments and strings are cut, names and calls are found by patterns: this is no parser, and errs on the side of a violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.operators.shared import in_ranges, with_previous

# Words, functions and prefixes that are refused, and functions that are allowed, in all engines and by engine.
MOST_CHARACTERS = 20_000
FORBIDDEN_WORDS = "INSERT UPDATE DELETE MERGE DROP ALTER CREATE TRUNCATE GRANT REVOKE EXECUTE EXEC CALL COPY LOCK INTO TABLE".split()
FORBIDDEN_FUNCTIONS = (
    "NEXTVAL CURRVAL SETVAL LASTVAL XMLQUERY XMLTABLE EXTRACTVALUE EXISTSNODE XMLSEQUENCE UPDATEXML PG_ADVISORY_LOCK "
    "PG_ADVISORY_XACT_LOCK PG_RELOAD_CONF LO_CREATE LO_FROM_BYTEA LO_PUT LO_UNLINK HTP HTF DBLINK DBLINK_EXEC DBLINK_CONNECT "
    "QUERY_TO_XML QUERY_TO_XML_AND_XMLSCHEMA QUERY_TO_XMLSCHEMA CURSOR_TO_XML TABLE_TO_XML TABLE_TO_XML_AND_XMLSCHEMA "
    "SCHEMA_TO_XML DATABASE_TO_XML DBMS_XMLGEN DBMS_XMLQUERY XMLTYPE DBURITYPE HTTPURITYPE XDBURITYPE DBMS_LOB DBMS_METADATA "
    "SYS_CONTEXT DBMS_SQL DBMS_SCHEDULER DBMS_JOB UTL_HTTP UTL_FILE UTL_TCP UTL_SMTP UTL_INADDR PG_READ_FILE "
    "PG_READ_BINARY_FILE PG_LS_DIR PG_STAT_FILE LO_IMPORT LO_EXPORT LO_GET PG_SLEEP SET_CONFIG PG_TERMINATE_BACKEND PG_CANCEL_BACKEND"
).split()
ORACLE_PREFIXES = "DBMS_ UTL_ OWA_ CTX_ SDO_ APEX_".split()
COMMON_FUNCTIONS = (
    "COUNT SUM AVG MIN MAX STDDEV STDDEV_POP STDDEV_SAMP VARIANCE VAR_POP VAR_SAMP CORR COVAR_POP COVAR_SAMP PERCENTILE_CONT "
    "PERCENTILE_DISC ROLLUP CUBE GROUPING ROW_NUMBER RANK DENSE_RANK PERCENT_RANK CUME_DIST NTILE LAG LEAD FIRST_VALUE LAST_VALUE "
    "NTH_VALUE COALESCE NULLIF GREATEST LEAST CAST TO_CHAR TO_DATE TO_NUMBER TO_TIMESTAMP UPPER LOWER INITCAP TRIM LTRIM RTRIM LPAD "
    "RPAD SUBSTR LENGTH REPLACE TRANSLATE CONCAT POSITION OVERLAY ASCII CHR REGEXP_REPLACE ABS CEIL FLOOR ROUND TRUNC MOD POWER SQRT "
    "EXP LN LOG SIGN SIN COS TAN ASIN ACOS ATAN ATAN2 SINH COSH TANH WIDTH_BUCKET EXTRACT CURRENT_DATE CURRENT_TIMESTAMP "
    "LOCALTIMESTAMP NUMERIC DECIMAL DEC CHAR VARCHAR FLOAT TIMESTAMP TIME DATE INTERVAL YEAR MONTH DAY HOUR MINUTE SECOND"
).split()
ORACLE_FUNCTIONS = (
    "MEDIAN LISTAGG APPROX_COUNT_DISTINCT RATIO_TO_REPORT GROUPING_ID NVL NVL2 DECODE NANVL SYSDATE SYSTIMESTAMP INSTR SOUNDEX "
    "NLS_UPPER NLS_LOWER NLS_INITCAP LENGTHB REGEXP_SUBSTR REGEXP_INSTR REGEXP_COUNT REGEXP_LIKE REMAINDER BITAND ADD_MONTHS "
    "MONTHS_BETWEEN LAST_DAY NEXT_DAY FROM_TZ SYS_EXTRACT_UTC NUMTODSINTERVAL NUMTOYMINTERVAL TO_DSINTERVAL TO_YMINTERVAL "
    "TO_TIMESTAMP_TZ TO_NCHAR TO_CLOB TO_BINARY_FLOAT TO_BINARY_DOUBLE RAWTOHEX HEXTORAW JSON_VALUE JSON_QUERY JSON_EXISTS "
    "JSON_OBJECT JSON_ARRAY JSON_ARRAYAGG JSON_OBJECTAGG VARCHAR2 NVARCHAR2 NCHAR NUMBER RAW UROWID"
).split()
POSTGRES_FUNCTIONS = (
    "STRING_AGG ARRAY_AGG BOOL_AND BOOL_OR EVERY BIT_AND BIT_OR MODE ANY_VALUE SUBSTRING LEFT RIGHT BTRIM SPLIT_PART STRPOS CONCAT_WS "
    "FORMAT REVERSE MD5 TO_HEX STARTS_WITH CHAR_LENGTH CHARACTER_LENGTH OCTET_LENGTH BIT_LENGTH REGEXP_MATCH CEILING DIV CBRT DEGREES "
    "RADIANS PI SCALE NOW DATE_TRUNC DATE_PART DATE_BIN AGE MAKE_DATE MAKE_TIMESTAMP MAKE_INTERVAL ISFINITE CURRENT_TIME LOCALTIME "
    "ARRAY_LENGTH ARRAY_TO_STRING ARRAY_POSITION STRING_TO_ARRAY ARRAY_APPEND CARDINALITY NUM_NULLS NUM_NONNULLS TO_JSON TO_JSONB "
    "ROW_TO_JSON JSON_BUILD_OBJECT JSONB_BUILD_OBJECT JSON_BUILD_ARRAY JSONB_BUILD_ARRAY JSON_AGG JSONB_AGG JSON_OBJECT_AGG "
    "JSONB_OBJECT_AGG JSON_TYPEOF JSONB_TYPEOF JSON_ARRAY_LENGTH JSONB_ARRAY_LENGTH JSONB_PRETTY JSON_EXTRACT_PATH "
    "JSON_EXTRACT_PATH_TEXT JSONB_EXTRACT_PATH JSONB_EXTRACT_PATH_TEXT JSONB_STRIP_NULLS VARYING BIT"
).split()
#: Words that stand before a bracket without being a call.
SYNTAX_WORDS = "IN AND OR NOT EXISTS ON WHERE SELECT FROM AS WHEN THEN ELSE CASE VALUES UNION INTERSECT EXCEPT MINUS ALL ANY SOME DISTINCT USING BETWEEN IS JOIN WITH HAVING GROUP ARRAY ROW OVER FILTER BY LIMIT OFFSET WITHIN LATERAL PARTITION ORDER".split()

#: Strings and comments, which are cut, or quoted names, which stay: whichever begins first.
_CUT = r"""'[^']*(?:''[^']*)*'|("[^"]*")|--[^\n]*|/\*(?s:.*?)\*/"""
_COMMENTS = r"--[^\n]*|/\*(?s:.*?)\*/"


def allowed_functions(engine: str) -> list[str]:
    return COMMON_FUNCTIONS + (ORACLE_FUNCTIONS if engine == "oracle" else POSTGRES_FUNCTIONS)


def screen_sql(log: DataFrame, engine: str = "postgres", allowed: list[str] | None = None) -> DataFrame:
    """(id, violation, token) of logged texts (id, sql_text): each rule that a text breaks, with the word or function, once.

    Rules: too long, several statements, start (not SELECT or WITH), forbidden word, blocked function (of Oracle also by prefix, called or not), and function
    not on the list of ``allowed`` ones. Quoted names are functions too, but no keywords; names of WITH clauses with columns are no calls.
    """
    known = allowed_functions(engine) if allowed is None else allowed
    bare = F.regexp_replace("sql_text", _CUT, "$1 ")
    body = F.regexp_replace(F.trim(bare), r"\s*;\s*$", "")
    log = log.select("id", "sql_text", body.alias("body")).withColumn("plain", F.regexp_replace("body", r'"[^"]*"', '""'))
    words = F.array_distinct(F.transform(F.regexp_extract_all("plain", F.lit(r"([A-Za-z_][A-Za-z0-9_$#]*)"), 1), F.upper))
    quoted = F.transform(F.regexp_extract_all("body", F.lit(r'"([^"]*)"'), 1), F.upper)
    calls = F.transform(F.regexp_extract_all("body", F.lit(r'([A-Za-z_][A-Za-z0-9_$#]*|"[^"]*")\s*\('), 1), lambda c: F.upper(F.replace(c, F.lit('"'), F.lit(""))))
    named = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)(?:with|,)\s+([A-Za-z_][A-Za-z0-9_$#]*)\s*\([^()]*\)\s+as\s*\("), 1), F.upper)
    listed = lambda names: F.array(*map(F.lit, names))
    names = F.array_union(words, quoted)
    blocked = lambda n: n.isin(*FORBIDDEN_FUNCTIONS) | (n.rlike("^(?:" + "|".join(ORACLE_PREFIXES) + ")") if engine == "oracle" else F.lit(False))
    refused = F.filter(names, blocked)
    one = lambda when, violation, token: F.when(when, F.array(F.struct(F.lit(violation).alias("violation"), token.alias("token")))).otherwise(F.array().cast("array<struct<violation:string,token:string>>"))
    each = lambda found, violation: F.transform(found, lambda t: F.struct(F.lit(violation).alias("violation"), t.alias("token")))
    found = F.concat(
        one(F.length("sql_text") > MOST_CHARACTERS, "too long", F.length("sql_text").cast("string")),
        one(F.col("plain").contains(";"), "several statements", F.lit(";")),
        one(~F.col("plain").rlike(r"(?i)^\s*(select|with)\b"), "start", F.upper(F.regexp_extract("plain", r"^\s*([A-Za-z]*)", 1))),
        each(F.array_intersect(words, listed(FORBIDDEN_WORDS)), "forbidden word"),
        each(refused, "blocked function"),
        each(F.array_except(F.array_except(F.array_distinct(calls), listed([*known, *SYNTAX_WORDS, *FORBIDDEN_WORDS])), F.array_union(refused, named)), "function not allowed"),
    )
    return log.select("id", F.explode(found).alias("v")).select("id", "v.violation", "v.token")


def statement_kind(c: str = "sql_text") -> F.Column:
    """select, dml, ddl or other, by the first word after comments."""
    word = F.lower(F.regexp_extract(F.regexp_replace(c, _COMMENTS, " "), r"^\s*([A-Za-z]+)", 1))
    return F.when(word.isin("select", "with"), "select").when(word.isin("insert", "update", "delete", "merge"), "dml").when(word.isin("create", "alter", "drop", "truncate"), "ddl").otherwise("other")


def filter_log(log: DataFrame, text: str = "", kind: str | None = None, favorites: bool = False, days: int | None = None, now: str | None = None) -> DataFrame:
    """Entries (sql_text, description, favorite, created_at, ...) with the text, blind to case, of the kind, the favourites, since some days before ``now``; 0 days is that day."""
    needle = text.strip().lower()
    if needle:
        log = log.where(F.lower("sql_text").contains(needle) | F.coalesce(F.lower("description").contains(needle), F.lit(False)))
    if kind:
        log = log.where(statement_kind() == kind)
    if favorites:
        log = log.where("favorite")
    if days is not None:
        end = F.to_timestamp_ntz(F.lit(now)) if now else F.localtimestamp()
        since = end - F.make_dt_interval(F.lit(days)) if days else F.to_timestamp_ntz(F.to_date(end).cast("string"))
        log = log.where(F.col("created_at") >= since)
    return log


def drop_repeats(log: DataFrame) -> DataFrame:
    """Entries (id, sql_text, ...) whose text isn't that of the entry before, in one log by id."""
    placed = with_previous(in_ranges(log, "id"), "sql_text", "before")
    return placed.where("before is null or before != sql_text").drop("place", "range", "before")
