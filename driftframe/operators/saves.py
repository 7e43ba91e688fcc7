"""Plans of files that definitions are saved as: where each goes, what it is called and what it holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.operators.shared import few, written
from driftframe.operators.text import bad_file_name, file_name, line_endings

#: Templates of the two naming conventions, and the type that holds both parts of a package.
TEMPLATES = {"timestamp": "{date}_{time}_{schema}${description}{ext}", "flyway": "V{version}__{schema}_{description}{ext}"}
BOTH_PARTS = "PACKAGE SPEC AND BODY"
OPTIONS = {"folder_path": "", "code_folder": "code", "migration_folder": "migration", "naming_convention": "timestamp", "naming_template": "", "folder_mode": "year", "version_label": "", "line_endings": "keep"}
#: Different templates that overrides may name; each is a branch of an expression.
MOST_TEMPLATES = 200


def _filled(c: F.Column | str) -> F.Column:
    return F.nullif(F.trim(c), F.lit(""))


def _named(template: F.Column, texts: list[str], values: dict[str, F.Column]) -> F.Column:
    """A name by whichever template a row has; null for one that is no template."""
    out = F.when(F.lit(False), F.lit(""))
    for text in texts:
        try:
            out = out.when(template == text, file_name(text, values))
        except ValueError:
            continue
    return out


def save_plan(objects: DataFrame, types: DataFrame, overrides: DataFrame, existing: DataFrame, now: str, root: str = "sql", options: Mapping[str, str] | None = None) -> DataFrame:
    """(object_id, kind, path, name, content, sha256, exists, violation) of the files of each object: code, migration or both.

    objects: (object_id, engine, schema_name, object_type, name, description, ddl, deploy); a migration holds deploy, or ddl where that is null. Each of OPTIONS
    is the schema's, from ``overrides`` (schema_name and OPTIONS, with maps storage_modes and extensions by type in capitals), else that
    given, else the usual one; storage mode and extension are the schema's for the type, else the type's in ``types`` (object_type, storage_mode, extension). Blank is not set.
    existing: (path, name) of files that are there. A migration goes to the year's folder or the version's, if that has files, else to ``new``, if
    that has, else beside them; its version follows the largest in its folder and those in it, as if each object were saved alone.
    violation: why a file can't be written; its name is null where the template is none.
    """
    usual = {**OPTIONS, **(options or {})}
    preset = lambda c: F.when(F.trim(c) == "flyway", TEMPLATES["flyway"]).otherwise(TEMPLATES["timestamp"])
    own = few(overrides.select(F.lower("schema_name").alias("schema"), *(F.col(c).alias(f"o_{c}") for c in (*OPTIONS, "storage_modes", "extensions"))))
    by_type = few(types.select(F.upper("object_type").alias("type"), F.col("storage_mode").alias("t_mode"), F.col("extension").alias("t_extension")))
    kind_of = F.upper(F.trim("object_type"))
    rows = objects.withColumns({"schema": F.lower("schema_name"), "whole": kind_of, "type": F.when(kind_of == BOTH_PARTS, "PACKAGE").otherwise(kind_of)})
    rows = rows.join(own, "schema", "left").join(by_type, "type", "left")
    option = lambda c: F.coalesce(_filled(f"o_{c}"), F.lit(usual[c]))
    typed = lambda m, c: F.coalesce(_filled(F.try_element_at(f"o_{m}", F.col("type"))), _filled(c))
    mode, extension = typed("storage_modes", "t_mode"), F.coalesce(typed("extensions", "t_extension"), F.lit(""))
    template = F.coalesce(_filled("o_naming_template"), F.when(_filled("o_naming_convention").isNotNull(), preset("o_naming_convention")), _filled(F.lit(usual["naming_template"])), preset(F.lit(usual["naming_convention"])))
    schema_dir = F.coalesce(_filled("o_folder_path"), _filled(F.lit(usual["folder_path"])), F.concat_ws("/", F.lit(root), "schema"))
    period = F.when(option("folder_mode") == "version", F.trim(option("version_label"))).otherwise(F.lit(now[:4]))
    kinds = F.when(mode.isin("code", "migration"), F.array(mode)).otherwise(F.array(F.lit("code"), F.lit("migration")))
    rows = rows.withColumns({"dir": schema_dir, "template": template, "ext": extension, "convention": option("naming_convention"), "endings": option("line_endings"), "period": _filled(period)})
    rows = rows.withColumns({"code_path": F.concat_ws("/", "dir", option("code_folder"), "schema"), "base": F.concat_ws("/", "dir", option("migration_folder"))}).withColumn("kind", F.explode(kinds))

    existing = written(existing.select("path", "name").distinct(), "existing")  # read for folders, versions and names
    folders = existing.select(F.col("path").alias("folder")).distinct()
    version = F.regexp_extract("name", r"^V(\d+)__", 1).try_cast("int")
    above = F.array_distinct(F.array("path", F.regexp_replace("path", r"/[^/]*$", "")))
    top = existing.withColumn("version", version).where("version is not null").select(F.explode(above).alias("base"), "version").groupBy("base").agg(F.max("version").alias("top"))
    rows = rows.withColumns({"at_period": F.concat(F.col("base"), F.lit("/"), "period"), "at_new": F.concat(F.col("base"), F.lit("/new"))}).join(few(top), "base", "left")
    for place in ("at_period", "at_new"):
        rows = rows.join(few(folders.select(F.col("folder").alias(place), F.col("folder").alias(f"is_{place}"))), place, "left")
    migration_path = F.coalesce("is_at_period", "is_at_new", "base")

    named = [r[0] for r in overrides.select(_filled("naming_template").alias("t")).where("t is not null").distinct().limit(MOST_TEMPLATES + 1).collect()]
    if len(named) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    texts = sorted({*named, *TEMPLATES.values(), *filter(None, [usual["naming_template"].strip()])})
    # without the object or a description two objects would have one name
    said = F.when(~F.contains("template", F.lit("{object}")) & (F.trim(F.coalesce("description", F.lit(""))) == ""), F.col("name")).otherwise(F.col("description"))
    day, clock = now[2:4] + now[5:7] + now[8:10], now[11:13] + now[14:16]
    values = {"date": F.lit(day), "time": F.lit(clock), "schema": F.col("schema"), "object": F.col("name"), "type": F.col("object_type"), "description": said, "version": F.coalesce("top", F.lit(0)) + 1, "ext": F.col("ext")}
    bare = F.regexp_replace("ext", r"^\.+", "")
    code_name = F.concat(F.when(F.col("convention") == "flyway", "R__").otherwise(""), F.col("name"), F.when(bare != "", F.concat(F.lit("."), bare)).otherwise(""))
    code = F.col("kind") == "code"
    rows = rows.withColumns({"path": F.when(code, F.col("code_path")).otherwise(migration_path), "file": F.when(code, code_name).otherwise(_named(F.col("template"), texts, values)), "text": F.when(code, F.col("ddl")).otherwise(F.coalesce("deploy", "ddl"))})
    content = F.when(F.col("endings") == "keep", F.col("text"))
    for style in ("lf", "crlf"):
        content = content.when(F.col("endings") == style, line_endings("text", style))
    violation = F.when((F.col("whole") == BOTH_PARTS) & (F.lower("engine") == "postgres"), "no packages here").when(~F.col("endings").isin("keep", "lf", "crlf"), "unknown line endings").when(F.col("file").isNull(), "bad template")
    out = rows.select("object_id", "kind", "path", F.col("file").alias("name"), content.alias("content"), violation.otherwise(bad_file_name(F.col("file"))).alias("violation"))
    held = existing.withColumn("exists", F.lit(True))
    return out.join(held, ["path", "name"], "left").select("object_id", "kind", "path", "name", "content", F.sha2("content", 256).alias("sha256"), F.coalesce("exists", F.lit(False)).alias("exists"), "violation")
