"""JSON of the source databases: kinds, paths, nulls and ordered aggregates, over texts and Spark's VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A JSON string, matched whole, so that nothing inside one is taken for a sign of the structure.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_COMPACT = rf"regexp_replace(j, r'({_STRING})|\s+', '$1')"
#: Where a field is null its key, itself and the comma after it go; then commas before a closing brace.
_FIELDS = rf"regexp_replace({_COMPACT}, r'{_STRING}:null(?:,|(?=\}}))|({_STRING})', '$1')"
_STRIPPED = rf"regexp_replace({_FIELDS}, r'({_STRING})|,(?=\}})', '$1')"
#: One value and nothing after it, which a parser of values alone does not say.
_VALID = "json_array_length(concat('[', j, ']')) = 1"
_PATH = "concat('$', array_join(transform(path, p -> IF(p RLIKE '^[0-9]+$', concat('[', p, ']'), concat('[\\'', p, '\\']'))), ''))"
_KIND = "CASE substr(ltrim(j), 1, 1) WHEN '{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' ELSE IF(j IS NULL, NULL, 'number') END"

#: Name, arguments, result and body of each.
FUNCTIONS = (
    ("pg_json_typeof", "j STRING", "STRING", f"IF({_VALID}, {_KIND}, NULL)"),
    ("pg_json_strip_nulls", "j STRING", "STRING", f"IF({_VALID}, {_STRIPPED}, NULL)"),
    ("pg_json_extract_path_text", "j STRING, path ARRAY<STRING>", "STRING", f"get_json_object(j, {_PATH})"),
    ("pg_jsonb_pretty", "j STRING", "STRING", "to_json(try_parse_json(j), map('pretty', 'true'))"),
    ("pg_json_array_length", "j STRING", "INT", "json_array_length(j)"),
    ("ora_json_value", "j STRING, path STRING", "STRING", "CASE WHEN substr(schema_of_variant(try_variant_get(try_parse_json(j), path, 'variant')), 1, 5) NOT IN ('OBJEC', 'ARRAY') THEN try_variant_get(try_parse_json(j), path, 'string') END"),
    ("ora_json_query", "j STRING, path STRING", "STRING", "CASE WHEN substr(schema_of_variant(try_variant_get(try_parse_json(j), path, 'variant')), 1, 5) IN ('OBJEC', 'ARRAY') THEN to_json(try_variant_get(try_parse_json(j), path, 'variant')) END"),
    ("ora_json_exists", "j STRING, path STRING", "BOOLEAN", "IF(j IS NULL, NULL, try_variant_get(try_parse_json(j), path, 'variant') IS NOT NULL)"),
)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_value(c: str | Column) -> Column:
    """A value as JSON text; null is ``null``."""
    one = F.to_json(F.array(_column(c)), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(2), F.length(one) - 2)


def json_arrayagg(c: str | Column, *order: str | Column, absent_on_null: bool = True) -> Column:
    """Aggregate: a group's values as a JSON array, in an order; nulls are left out or (PostgreSQL) kept."""
    c = _column(c)
    rows = F.collect_list(F.when(c.isNotNull() if absent_on_null else F.lit(True), F.struct(*(_column(o).alias(f"o{i}") for i, o in enumerate(order)), json_value(c).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(rows), lambda x: x["v"]), ","), F.lit("]"))


def json_objectagg(key: str | Column, c: str | Column, absent_on_null: bool = False) -> Column:
    """Aggregate: a group's keys and values as a JSON object, in the order of the keys; repeated keys all stay, as in a JSON text."""
    c = _column(c)
    rows = F.collect_list(F.when(c.isNotNull() if absent_on_null else F.lit(True), F.struct(json_value(_column(key).cast("string")).alias("k"), json_value(c).alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat(x["k"], F.lit(":"), x["v"])), ","), F.lit("}"))
