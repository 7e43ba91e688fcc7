"""SQL functions of the source databases that Spark lacks, as temporary SQL functions that the optimizer inlines.

Names that Spark has with another meaning begin with ``ora_`` or ``pg_``. Format models are compiled by ``formats``, JSON aggregates are columns of
``json_values``, functions of any number of arguments or of a pattern columns of ``texts``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from driftframe.functions import dates, json_values, texts

_DECIMAL = "CAST(try_cast(abs(x) AS DECIMAL(38, 15)) AS STRING)"
_POINT = f"instr({_DECIMAL}, '.')"
#: Name, arguments, result and body of each.
FUNCTIONS = (
    # towards zero, by the decimal digits, so that 2.9999999999 stays below 3; from 1e23 on a number has no digits to cut
    ("trunc_number", "x DOUBLE, digits INT", "DOUBLE", f"CASE WHEN {_DECIMAL} IS NULL THEN x WHEN digits >= 0 THEN sign(x) * CAST(substr({_DECIMAL}, 1, {_POINT} + digits) AS DOUBLE) ELSE sign(x) * CAST(rpad(substr({_DECIMAL}, 1, greatest({_POINT} - 1 + digits, 0)), {_POINT} - 1, '0') AS DOUBLE) END"),
    ("nanvl_number", "x DOUBLE, other DOUBLE", "DOUBLE", "CASE WHEN isnan(x) THEN other ELSE x END"),
    ("remainder_number", "a DOUBLE, b DOUBLE", "DOUBLE", "a - b * rint(a / b)"),
    ("instr_from", "s STRING, part STRING, start INT, nth INT", "INT", "coalesce(try_element_at(filter(sequence(start, greatest(start, length(s))), i -> substr(s, i, length(part)) = part), nth), 0)"),
    ("to_number_text", "s STRING", "DOUBLE", "try_cast(regexp_replace(trim(s), '[,$]', '') AS DOUBLE)"),
    ("nvl2_text", "x STRING, a STRING, b STRING", "STRING", "IF(x IS NOT NULL, a, b)"),
    ("pg_scale", "x STRING", "INT", "length(regexp_extract(x, '[.]([0-9]*)$', 1))"),
    ("pg_to_hex", "x BIGINT", "STRING", "lower(hex(x))"),
    ("pg_num_nulls", "x ARRAY<STRING>", "INT", "size(filter(x, v -> v IS NULL))"),
    ("pg_num_nonnulls", "x ARRAY<STRING>", "INT", "size(filter(x, v -> v IS NOT NULL))"),
    ("pg_array_position", "x ARRAY<STRING>, v STRING", "INT", "nullif(CAST(array_position(x, v) AS INT), 0)"),
    ("ora_concat", "a STRING, b STRING", "STRING", "concat(coalesce(a, ''), coalesce(b, ''))"),
    ("ora_greatest", "a DOUBLE, b DOUBLE", "DOUBLE", "IF(a IS NULL OR b IS NULL, NULL, greatest(a, b))"),
    ("ora_least", "a DOUBLE, b DOUBLE", "DOUBLE", "IF(a IS NULL OR b IS NULL, NULL, least(a, b))"),
    ("ora_regexp_instr", "s STRING, pattern STRING", "INT", "regexp_instr(s, pattern)"),
    *dates.FUNCTIONS,
    *json_values.FUNCTIONS,
    *texts.FUNCTIONS,
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
