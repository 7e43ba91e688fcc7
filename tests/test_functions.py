"""Functions of the source databases: format models, dates, JSON."""

import datetime
import decimal

import pytest
from driftframe import functions
from driftframe.functions import formats, json_values, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

WHEN = "timestamp_ntz'2024-03-05 13:07:09.123456'"


@pytest.fixture(scope="module")
def registered(spark):
    functions.register(spark)
    return lambda expression: spark.sql(f"SELECT {expression} AS v").first()[0]


@pytest.mark.parametrize(
    ("model", "oracle", "postgres"),
    [
        ("YYYY-MM-DD HH24:MI:SS.FF3", "2024-03-05 13:07:09.123", None),
        ("Month/DAY dy D DDD", "March    /TUESDAY   tue 3 065", None),
        ("fmMonth DD, YYYY MM", "March 5, 2024 3", "March 05, 2024 03"),
        ("FMDD FMMM", "5 03", "5 3"),
        ("DDth MON RR HH12:MI a.m.", "05th MAR 24 01:07 p.m.", None),
        ("J Q WW IW W CC SSSSS", "2460375 1 10 10 1 21 47229", None),
        ('"it\'s \\" YYYY Y,YYY IYYY', "it's \\ 2024 2,024 2024", None),
        ("FF FF1 FF9 MS US", "123456 1 123456000 123 123456", None),
    ],
)
def test_dates_as_text(spark, model, oracle, postgres):
    row = spark.sql(f"SELECT {WHEN} AS t").select(formats.to_char_date("t", model), formats.to_char_date("t", model, engine="postgres")).first()
    assert tuple(row) == (oracle, postgres or oracle)


@pytest.mark.parametrize(
    ("model", "want"),
    [
        ("999", [" 485", "-485", "   0", "####"]),
        ("99999D99", ["   485.00", "  -485.00", "      .00", " 12345.68"]),
        ("FM99999.99", ["485.", "-485.", ".", "12345.68"]),
        ("9990999.9", ["    0485.0", "   -0485.0", "    0000.0", "   12345.7"]),
        ("S99G999", ["   +485", "   -485", "     +0", "+12,346"]),
        ("99999S", ["  485+", "  485-", "    0+", "12346+"]),
        ("FM99999MI", ["485", "485-", "0", "12346"]),
        ("99999PR", ["   485 ", "  <485>", "     0 ", " 12346 "]),
        ("$99,990.00", ["    $485.00", "   -$485.00", "      $0.00", " $12,345.68"]),
        ("FM00000000", ["00000485", "-00000485", "00000000", "00012346"]),
    ],
)
def test_numbers_as_text(spark, model, want):
    rows = spark.createDataFrame([(decimal.Decimal(x),) for x in ("485", "-485", "0", "12345.678")], "x decimal(20,3)")
    assert [r[0] for r in rows.select(formats.to_char_number("x", model)).collect()] == want


@pytest.mark.parametrize("model", ["YYYY-XX", '"open', "HH25?!Z", "AB"])
def test_unknown_elements_of_dates_are_errors(model):
    with pytest.raises(ValueError):
        formats.date_text_sql("x", model)
    with pytest.raises(ValueError):
        formats.timestamp_sql("x", model)


@pytest.mark.parametrize("model", ["9.9.9", "9A", "", "9.9,9", "9S9", "MI9", "PR99"])
def test_unknown_elements_of_numbers_are_errors(model):
    with pytest.raises(ValueError):
        formats.number_text_sql("x", model)


def test_texts_as_timestamps(spark):
    texts = ["05-MAR-2024 01:07:09.123456 PM", " 5/mar/2024 1:07:09.5pm", "31-feb-2024 01:00:00.0 am", "05-xyz-2024 01:00:00.0 am", "", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(formats.to_timestamp("s", "DD-MON-YYYY HH12:MI:SS.FF AM")).collect()]
    assert got == [datetime.datetime(2024, 3, 5, 13, 7, 9, 123456), datetime.datetime(2024, 3, 5, 13, 7, 9, 500000), None, None, None, None, None]
    with pytest.raises(PySparkException):
        df.select(formats.to_timestamp("s", "DD-MON-YYYY HH12:MI:SS.FF AM", strict=True)).collect()
    other = spark.createDataFrame([("24-060", "2460375", "March 5 49", "12 50")], "a string, b string, c string, d string")
    got = other.select(formats.to_timestamp("a", "RR-DDD"), formats.to_date("b", "J"), formats.to_date("c", "MONTH DD RR"), formats.to_date("d", "MM RR")).first()
    assert tuple(got) == (datetime.datetime(2024, 2, 29), datetime.date(2024, 3, 5), datetime.date(2049, 3, 5), datetime.date(1950, 12, 1))


@given(st.lists(st.datetimes(datetime.datetime(1950, 1, 1), datetime.datetime(2049, 12, 31)), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_dates_come_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
    for model in ("YYYY-MM-DD HH24:MI:SS.FF6", "FMDay, DD Month YYYY HH12:MI:SS.FF AM", "RR/DDD SSSSS.US", "J HH24MISSFF"):
        shown = df.select("t", formats.to_char_date("t", model).alias("s"))
        assert [r[0] for r in shown.select(formats.to_timestamp("s", model)).collect()] == values


def test_texts_as_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (" $1,234.50 ", "-12", "12345678", "<3.1>", "12-", "", ".", None)], "s string")
    read = lambda model: [r[0] and float(r[0]) for r in df.select(formats.to_number("s", model)).collect()]
    assert read("$9,999.99") == [1234.5, -12, None, None, None, None, None, None]
    assert read("99.9PR") == [None, None, None, -3.1, None, None, None, None]
    assert read("S999") == [None, -12, None, None, None, None, None, None]
    assert read("999S") == [None, None, None, None, -12, None, None, None]
    with pytest.raises(PySparkException):
        df.select(formats.to_number("s", "9", strict=True)).collect()


def test_models_as_sql_functions(spark):
    formats.register_models(spark, {"iso_day": ("to_char_date", "YYYY-MM-DD"), "from_iso_day": ("to_timestamp", "YYYY-MM-DD"), "money": ("to_char_number", "FM999,990.00")})
    assert tuple(spark.sql(f"SELECT iso_day({WHEN}), from_iso_day(iso_day({WHEN})), money(1234.5)").first()) == ("2024-03-05", datetime.datetime(2024, 3, 5), "1,234.50")


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("ora_add_months(timestamp_ntz'2024-02-29 10:00:00', 1)", datetime.datetime(2024, 3, 31, 10)),
        ("ora_add_months(timestamp_ntz'2024-01-30', 1)", datetime.datetime(2024, 2, 29)),
        ("ora_months_between(timestamp_ntz'2024-03-31 05:00:00', timestamp_ntz'2024-02-29')", 1.0),
        ("ora_months_between(timestamp_ntz'2024-02-10', timestamp_ntz'2024-03-10 09:00:00')", -1.0),
        ("CAST(ora_to_dsinterval('-3 04:05:06.7') AS STRING)", "INTERVAL '-3 04:05:06.7' DAY TO SECOND"),
        ("ora_to_dsinterval('soon')", None),
        ("CAST(ora_to_yminterval('-1-03') AS STRING)", "INTERVAL '-1-3' YEAR TO MONTH"),
        ("ora_sys_extract_utc(ora_from_tz(timestamp_ntz'2024-07-01 12:00:00', 'America/New_York'))", datetime.datetime(2024, 7, 1, 16)),
        ("pg_age(timestamp_ntz'2024-03-10 01:00:00', timestamp_ntz'2024-01-15 02:00:00').months", 1),
        ("CAST(pg_age(timestamp_ntz'2024-03-10 01:00:00', timestamp_ntz'2024-01-15 02:00:00').rest AS STRING)", "INTERVAL '25 23:00:00' DAY TO SECOND"),
        ("pg_date_bin(INTERVAL '15' MINUTE, timestamp_ntz'2023-12-31 23:59:00', timestamp_ntz'2024-01-01 00:05:00')", datetime.datetime(2023, 12, 31, 23, 50)),
        ("trunc_number(0.9999999999, 0)", 0.0),
        ("trunc_number(2.9999999999, 0)", 2.0),
        ("trunc_number(-4.35, 2)", -4.35),
        ("trunc_number(12345.678, -2)", 12300.0),
        ("trunc_number(12.3, -5)", 0.0),
        ("trunc_number(1e300, 3)", 1e300),
        ("trunc_number(double('NaN'), 3) = double('NaN')", True),
        ("pg_json_strip_nulls('{\"a\": null, \"b\" : {\"c\":null,\"d\":[null,1,{\"e\":null}]}, \"x\":\":null,\", \"z\":null}')", '{"b":{"d":[null,1,{}]},"x":":null,"}'),
        ("pg_json_strip_nulls('{\"a\": ')", None),
        ("pg_json_typeof(' [1]')", "array"),
        ("pg_json_typeof('1, 2')", None),
        ("pg_json_typeof('null')", "null"),
        ("ora_json_query('{\"c\":2,\"s\":\"{x\"}', '$.s')", None),
        ("ora_json_value('{\"c\":[2]}', '$.c')", None),
    ],
)
def test_functions(registered, expression, want):
    assert registered(expression) == want


def test_json_aggregates_are_ordered(spark):
    df = spark.createDataFrame([("a", 2, "x\"y"), ("a", 1, None), ("a", 3, "z"), ("b", 1, None)], "g string, o int, v string")
    got = {r[0]: tuple(r)[1:] for r in df.groupBy("g").agg(json_values.json_arrayagg("v", "o"), json_values.json_arrayagg("v", "o", absent_on_null=False), json_values.json_objectagg("o", "v")).collect()}
    assert got == {"a": ('["x\\"y","z"]', '[null,"x\\"y","z"]', '{"1":null,"2":"x\\"y","3":"z"}'), "b": ("[]", "[null]", '{"1":null}')}


def test_texts_of_the_source_databases(spark, registered):
    asked = {
        "initcap_words('o''neil-mc donald2x')": "O'Neil-Mc Donald2x", "ora_substr('abc', 0, 2)": "ab", "ora_substr('abc', -2, 9)": "bc", "ora_substr('abc', -5, 3)": None, "ora_substr('abc', 1, 0)": None,
        "pg_substring('abcdef', -1, 4)": "ab", "pg_substring('abcdef', 5, 9)": "ef", "pg_substring('abc', -5, 2)": "", "ora_instr('abcabca', 'a', -1, 2)": 4, "ora_instr('abcabca', 'abc', -2, 1)": 4, "ora_instr('aaa', 'aa', 1, 2)": 2, "ora_instr('abc', 'z', 1, 1)": 0, "ora_instr('abc', 'abcd', 1, 1)": 0, "ora_instr('', 'a', 1, 1)": None,
        "pg_string_to_array('a.b.c', '.', 'b')": ["a", None, "c"], "pg_string_to_array('ab', NULL, NULL)": ["a", "b"], "pg_string_to_array('ab', '', NULL)": ["ab"], "pg_string_to_array('', ',', NULL)": [], "pg_string_to_array(NULL, ',', NULL)": None,
        "pg_array_length(array(), 1)": None, "pg_array_length(array('a'), 2)": None, "pg_array_to_string(array('a', NULL, 'b'), '-', NULL)": "a-b", "pg_array_to_string(array('a', NULL), '-', '*')": "a-*", "pg_div(-7, 2)": -3.0, "pg_log(1000)": pytest.approx(3.0),
        "bucket_number(5, 0, 10, 5)": 3, "bucket_number(10, 0, 10, 5)": 6, "bucket_number(-1, 0, 10, 5)": 0, "bucket_number(5, 10, 0, 5)": 3, "bucket_number(11, 10, 0, 5)": 0, "bucket_number(0, 10, 0, 5)": 6, "bucket_number(1, 0, 0, 5)": None, "ora_lengthb('ä')": 2,
    }
    row = spark.range(1).selectExpr(*(f"{e} AS c{i}" for i, e in enumerate(asked))).first()
    assert dict(zip(asked, row, strict=True)) == asked


def test_texts_by_pattern_and_template(spark):
    one = spark.createDataFrame([("a$b a$b", None)], "s string, n string")
    columns = [
        (texts.regexp_replace("s", r"a\$", r"\&$\\"), r"a$$\b a$b"), (texts.regexp_replace("s", "(B)", r"<\1>", "gi"), "a$<b> a$<b>"), (texts.regexp_replace("s", "^b", "x"), "a$b a$b"), (texts.regexp_replace("s", "(b)", r"2\1" + "0"), "a$2b0 a$b"), (texts.concat_present("n", "s"), "a$b a$b"),
        (texts.format_text("%I %L", "s", "n"), '"a$b a$b" NULL'), (texts.format_text("%2$s|%1$s", "s", "n"), "|a$b a$b"), (texts.regexp_match("s", "(b) (a)"), ["b", "a"]), (texts.regexp_match("s", "b"), ["b"]), (texts.regexp_match("s", "z"), None),
    ]
    assert list(one.select(*(c for c, _ in columns)).first()) == [v for _, v in columns]
    for make in (lambda: texts.format_text("%d", "s"), lambda: texts.format_text("%s %s", "s"), lambda: texts.regexp_replace("s", r"(a)\1", ""), lambda: texts.regexp_replace("s", "a", "", "x")):
        with pytest.raises(ValueError):
            make()
