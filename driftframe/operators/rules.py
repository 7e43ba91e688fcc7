"""Name rules and wildcards as joins with small rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftframe.operators.shared import few, is_few


def rule_like(match_type: str = "match_type", pattern: str = "pattern") -> F.Column:
    """LIKE pattern of a name rule; ``_`` in a rule matches any character, as it isn't escaped."""
    p = F.upper(pattern)
    kind = F.col(match_type)
    return F.when(kind == "prefix", F.concat(p, F.lit("%"))).when(kind == "suffix", F.concat(F.lit("%"), p)).when(kind == "contains", F.concat(F.lit("%"), p, F.lit("%"))).otherwise(p)


def wildcard_like(pattern: str | F.Column) -> F.Column:
    """LIKE pattern of a wildcard with * and ?; literal %, _ and the escape are escaped."""
    escaped = F.regexp_replace(pattern, r"([\\%_])", r"\\$1")
    return F.translate(escaped, "*?", "%_")


def wildcard_match(text: F.Column | str, pattern: F.Column | str, ci: bool = True) -> F.Column:
    text, pattern = (F.col(x) if isinstance(x, str) else x for x in (text, pattern))
    return F.like(F.upper(text), wildcard_like(F.upper(pattern))) if ci else F.like(text, wildcard_like(pattern))


#: Letters of a pattern's inside by which texts are looked up.
INSIDE = 3


def _keyed(patterns: DataFrame) -> DataFrame:
    """(like, key): what a text must begin with, else end with, else have inside, to match a pattern; null for one that says none of these."""
    tokens = F.regexp_extract_all("like", F.lit(r"\\[\s\S]|[\s\S]"), 0)
    plain = F.transform(tokens, lambda t: F.when(t.isin("%", "_"), F.lit("\x01")).when(F.length(t) == 2, F.substring(t, 2, 1)).otherwise(t))
    runs = F.split(F.array_join(plain, ""), "\x01")  # what stands for itself, between wildcards
    head, tail = F.element_at(runs, 1), F.element_at(runs, -1)
    inside = F.substring(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], 1, INSIDE)
    key = lambda side, x: F.struct(F.lit(side).alias("side"), F.length(x).alias("n"), x.alias("part"))
    return patterns.select("like", F.when(head != "", key("head", head)).when(tail != "", key("tail", tail)).when(F.length(inside) == INSIDE, key("inside", inside)).alias("key"))


def like_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, like): each distinct text with each distinct LIKE pattern that it matches.

    A few patterns are sent to every executor. Many are looked up by what they begin or end with, whole, or have inside: a text has a row for
    each length of these, and meets the patterns by equality; only patterns without such a part are compared with all texts.
    """
    if is_few(patterns):
        return texts.join(F.broadcast(patterns), F.like("text", F.col("like")))
    keyed = _keyed(patterns)
    sizes = keyed.where("key IS NOT NULL").select("key.side", "key.n").distinct().collect()  # as many as lengths of names
    text, none = F.col("text"), F.array().cast("array<struct<side: string, n: int, part: string>>")
    key = lambda side, n, x: F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), x.alias("part"))
    keys = [F.when(F.length(text) >= r["n"], F.array(key(r["side"], r["n"], F.left(text, F.lit(r["n"])) if r["side"] == "head" else F.right(text, F.lit(r["n"]))))).otherwise(none) for r in sizes if r["side"] != "inside"]
    if any(r["side"] == "inside" for r in sizes):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - INSIDE + 1, F.lit(1)))
        keys.append(F.array_distinct(F.transform(starts, lambda i: key("inside", INSIDE, F.substring(text, i, F.lit(INSIDE))))))
    found = texts.select("text", F.explode(F.flatten(F.array(*keys)) if keys else none).alias("key")).join(keyed.where("key IS NOT NULL"), "key").where(F.like("text", F.col("like"))).select("text", "like")
    loose = keyed.where("key IS NULL").select("like")
    return found.unionByName(texts.join(few(loose), F.like("text", F.col("like"))))


def match_patterns(names: DataFrame, patterns: DataFrame, column: str = "table_name", pattern: str = "table_pattern") -> DataFrame:
    """(name, pattern, exact): each name with each wildcard that matches it, blind to case, and whether it does so with case."""
    own = patterns.select(pattern).distinct()
    exact = wildcard_match(column, pattern, ci=False).alias("exact")
    if is_few(own):
        return names.join(F.broadcast(own), wildcard_match(column, pattern)).select(column, pattern, exact)
    pairs = like_pairs(names.select(F.upper(column).alias("text")).distinct(), own.select(wildcard_like(F.upper(pattern)).alias("like")).distinct())
    of_pattern = own.withColumn("like", wildcard_like(F.upper(pattern)))
    return names.withColumn("text", F.upper(column)).join(pairs, "text").join(of_pattern, "like").select(column, pattern, exact)


def _likes(rules: DataFrame, action: str) -> DataFrame:
    return rules.where(F.col("enabled") & (F.col("action") == action)).select(rule_like().alias("like")).distinct()


def _filtered(df: DataFrame, likes: DataFrame, column: str, how: str) -> DataFrame:
    """Rows whose name matches one of the patterns (left_semi) or none (left_anti)."""
    if is_few(likes):
        return df.join(F.broadcast(likes.withColumnRenamed("like", "__like")), F.like(F.upper(column), F.col("__like")), how)
    hit = like_pairs(df.select(F.upper(column).alias("text")).distinct(), likes).select(F.col("text").alias("__text")).distinct()
    return df.join(hit, F.upper(column) == F.col("__text"), how)


def apply_name_rules(df: DataFrame, rules: DataFrame, column: str = "table_name") -> DataFrame:
    """Rows whose name no enabled exclude rule matches and, where an include rule is enabled, some include rule does."""
    kept = _filtered(df, _likes(rules, "exclude"), column, "left_anti")
    if rules.where("enabled and action = 'include'").isEmpty():
        return kept
    return _filtered(kept, _likes(rules, "include"), column, "left_semi")


def match_rules(names: DataFrame, rules: DataFrame, column: str = "table_name") -> DataFrame:
    """Each name with each rule that matches it."""
    own = rules.where("enabled").withColumn("like", rule_like())
    if is_few(own):
        return names.join(F.broadcast(own), F.like(F.upper(column), F.col("like"))).drop("like", "enabled")
    pairs = like_pairs(names.select(F.upper(column).alias("text")).distinct(), own.select("like").distinct())
    return names.withColumn("text", F.upper(column)).join(pairs, "text").join(own, "like").drop("text", "like", "enabled")


def hide_objects(objects: DataFrame, deny: DataFrame, connection: str = "server_id") -> DataFrame:
    """Objects that no deny rule of their connection hides, by type and wildcard name, blind to case."""
    d = deny.select(F.col("connection_id").alias("__c"), F.col("object_type").alias("__t"), wildcard_like(F.upper("name_pattern")).alias("__p"))
    mine = (F.col(connection) == F.col("__c")) & (F.col("__t").isin("*", "") | (F.upper("__t") == F.upper("object_type")))
    if is_few(d):
        return objects.join(F.broadcast(d), mine & F.like(F.upper("name"), F.col("__p")), "left_anti")
    pairs = like_pairs(objects.select(F.upper("name").alias("text")).distinct(), d.select(F.col("__p").alias("like")).distinct())
    hidden = d.join(pairs, F.col("__p") == F.col("like")).select("__c", "__t", "text").distinct()
    return objects.join(hidden, mine & (F.upper("name") == F.col("text")), "left_anti")


def texts_mentioning_hidden(texts: DataFrame, deny: DataFrame, connection: int) -> DataFrame:
    """(doc_id, hits): distinct words of each text that a rule of the connection hides."""
    d = few(deny.where(F.col("connection_id") == connection).select(F.col("name_pattern").alias("__p")))
    words = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}_$#]+"))).alias("word")).where("word != ''")
    return words.join(d, wildcard_match("word", "__p"), "left_semi").groupBy("doc_id").agg(F.count("*").alias("hits"))


def table_access(tables: DataFrame, policies: DataFrame, rules: DataFrame, servers: DataFrame) -> DataFrame:
    """(connection_id, table_name, allowed, column_rules) of each table of each connection with a policy."""
    p = few(policies.select("connection_id", "data_access"))
    s = few(servers.select(F.col("server_id").alias("connection_id"), "engine"))
    base = tables.join(p, "connection_id").join(s, "connection_id", "left")
    r = few(rules.withColumnRenamed("connection_id", "__c"))
    folded = F.when(F.col("engine") == "oracle", wildcard_match("table_name", "table_pattern")).otherwise(wildcard_match("table_name", "table_pattern", ci=False))
    hit = F.when(F.col("action") == "deny", wildcard_match("table_name", "table_pattern")).otherwise(folded)
    matched = base.join(r, (F.col("connection_id") == F.col("__c")) & hit, "left")
    whole = F.col("column_pattern") == ""
    flags = matched.groupBy("connection_id", "table_name", "data_access").agg(
        F.coalesce(F.bool_or((F.col("action") == "deny") & whole), F.lit(False)).alias("denied"),
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("granted"),
        F.coalesce(F.bool_or(~whole), F.lit(False)).alias("column_rules"),
    )
    return flags.select("connection_id", "table_name", ((F.col("data_access") == "allowlist") & ~F.col("denied") & F.col("granted")).alias("allowed"), "column_rules")


def column_access(columns: DataFrame, policies: DataFrame, rules: DataFrame, servers: DataFrame) -> DataFrame:
    """(connection_id, table_name, column_name, allowed): table allowed, no column deny, and an allow by table or column."""
    tables = table_access(columns.select("connection_id", "table_name").distinct(), policies, rules, servers).select("connection_id", "table_name", F.col("allowed").alias("table_allowed"))
    s = few(servers.select(F.col("server_id").alias("connection_id"), "engine"))
    base = columns.select("connection_id", "table_name", "column_name").join(tables, ["connection_id", "table_name"]).join(s, "connection_id", "left")
    r = few(rules.withColumnRenamed("connection_id", "__c"))
    any_case = wildcard_match("table_name", "table_pattern") & ((F.col("column_pattern") == "") | wildcard_match("column_name", "column_pattern"))
    own_case = wildcard_match("table_name", "table_pattern", ci=False) & ((F.col("column_pattern") == "") | wildcard_match("column_name", "column_pattern", ci=False))
    hit = F.when((F.col("action") == "deny") | (F.col("engine") == "oracle"), any_case).otherwise(own_case)
    matched = base.join(r, (F.col("connection_id") == F.col("__c")) & hit, "left")
    keys = ["connection_id", "table_name", "column_name", "table_allowed"]
    flags = matched.groupBy(*keys).agg(F.coalesce(F.bool_or((F.col("action") == "deny") & (F.col("column_pattern") != "")), F.lit(False)).alias("denied"), F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("granted"))
    return flags.select(*keys[:3], (F.col("table_allowed") & ~F.col("denied") & F.col("granted")).alias("allowed"))


def history_pairs(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """(server_id, main, history, rule_id): main tables, which match no rule, with the first rule's history table that exists."""
    own = few(rules.where("enabled").withColumn("__like", rule_like()))
    main = tables.join(own, F.like(F.upper("table_name"), F.col("__like")), "left_anti").select("server_id", F.col("table_name").alias("main"))
    named = F.when(F.col("match_type") == "prefix", F.concat("pattern", "main")).when(F.col("match_type") == "suffix", F.concat("main", "pattern"))
    wanted = main.crossJoin(own.select("rule_id", "match_type", "pattern")).withColumn("candidate", F.lower(named)).where("candidate is not null")
    held = tables.select("server_id", F.col("table_name").alias("history"), F.lower("table_name").alias("candidate"))
    found = wanted.join(held, ["server_id", "candidate"])
    return found.groupBy("server_id", "main").agg(F.min_by(F.struct("history", "rule_id"), F.struct("rule_id", "history")).alias("h")).select("server_id", "main", "h.history", "h.rule_id")


def history_issues(columns: DataFrame, rules: DataFrame, servers: DataFrame) -> DataFrame:
    """(server_id, history_table, column_name, issue_type, main_type, history_type, statement) of all columns a history table lacks or has otherwise.

    The first column and large types are left out; a column matches by name, blind to case, or with the rule's prefix.
    """
    pairs = history_pairs(columns.select("server_id", "table_name").distinct(), rules)
    typed = F.when(F.col("data_length").isNotNull(), F.concat("data_type", F.lit("("), "data_length", F.lit(")"))).otherwise(F.col("data_type"))
    main = columns.select("server_id", F.col("table_name").alias("main"), "column_name", "column_id", typed.alias("main_type"), F.upper("data_type").alias("kind"))
    want = pairs.join(main, ["server_id", "main"]).where((F.col("column_id") > 1) & ~F.col("kind").isin("CLOB", "BLOB", "LONG", "LONG RAW"))
    prefix = few(rules.where("match_type = 'prefix'").select("rule_id", F.col("pattern").alias("prefix")))
    want = want.join(prefix, "rule_id", "left").withColumn("names", F.array_compact(F.array(F.upper("column_name"), F.upper(F.concat("prefix", "column_name")))))
    held = columns.select("server_id", F.col("table_name").alias("history"), F.upper("column_name").alias("held"), F.col("column_id").alias("held_id"), typed.alias("history_type"))
    keys = ["server_id", "main", "history", "column_name", "main_type"]
    found = want.withColumn("held", F.explode("names")).join(held, ["server_id", "history", "held"]).groupBy(*keys).agg(F.min_by("history_type", "held_id").alias("history_type"))
    both = want.select(*keys).join(found, keys, "left").join(few(servers.select("server_id", "engine")), "server_id", "left")
    issue = F.when(F.col("history_type").isNull(), "MISSING").when(F.upper("history_type") != F.upper("main_type"), "TYPE_MISMATCH")
    oracle = F.when(issue == "MISSING", F.format_string("ALTER TABLE %s ADD (%s %s);", "history", "column_name", "main_type")).otherwise(F.format_string("ALTER TABLE %s MODIFY (%s %s);", "history", "column_name", "main_type"))
    postgres = F.when(issue == "MISSING", F.format_string("ALTER TABLE %s ADD COLUMN IF NOT EXISTS %s %s;", "history", "column_name", "main_type")).otherwise(F.format_string("ALTER TABLE %s ALTER COLUMN %s TYPE %s USING %s::%s;", "history", "column_name", "main_type", "column_name", "main_type"))
    rows = both.withColumn("issue_type", issue).where("issue_type is not null").withColumn("statement", F.when(F.col("engine") == "oracle", oracle).otherwise(postgres))
    return rows.select("server_id", F.col("history").alias("history_table"), "column_name", "issue_type", "main_type", "history_type", "statement")


#: The agent's tools in their order, whether each reads data, and the settings that must all be on.
TOOLS = (
    ("list_schema_objects", False, ("allow_schema_list",)),
    ("get_object_ddl", False, ("allow_ddl_read",)),
    ("save_migration_script", False, ("allow_save_scripts",)),
    ("compare_schemas", False, ("allow_compare_fix",)),
    ("generate_fix_script", False, ("allow_compare_fix",)),
    ("compare_object", False, ("allow_compare_object", "allow_ddl_read")),
    ("query_table", True, ()),
    ("run_query", True, ("allow_raw_sql",)),
    ("list_invalid_objects", False, ("allow_invalid_objects", "allow_schema_list")),
    ("get_object_errors", False, ("allow_invalid_objects", "allow_ddl_read")),
    ("apply_ddl", False, ("allow_apply_ddl",)),
)
#: Limits of a policy.
DEFAULT_ROWS, MOST_ROWS, DEFAULT_SECONDS, MOST_SECONDS = 200, 10_000, 30, 600
MOST_RULES, MOST_PATTERN_BYTES, MOST_ACCOUNT_BYTES = 500, 128, 128
FLAGS = ("mcp_enabled", "allow_schema_list", "allow_ddl_read", "allow_save_scripts", "allow_compare_fix", "allow_invalid_objects", "allow_compare_object", "allow_raw_sql", "allow_apply_ddl")


def with_default_policies(connections: DataFrame, policies: DataFrame) -> DataFrame:
    """(connection_id, flags, data_access, max_rows, query_timeout_secs) of every connection (server_id): all off where it has no policy; limits within bounds."""
    own = connections.select(F.col("server_id").alias("connection_id")).join(policies, "connection_id", "left")
    bounded = lambda c, usual, most: F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(c, F.lit(usual)))).alias(c)
    return own.select("connection_id", *(F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS), F.coalesce("data_access", F.lit("none")).alias("data_access"), bounded("max_rows", DEFAULT_ROWS, MOST_ROWS), bounded("query_timeout_secs", DEFAULT_SECONDS, MOST_SECONDS))


def capability_matrix(policies: DataFrame, rules: DataFrame, data_tools_disabled: bool = False) -> DataFrame:
    """(connection_id, tool, allowed, reason_code, settings) of each connection with a policy and each tool.

    The first reason counts: access off, no data access, a setting off (settings names those needed), the global switch, no allow rule.
    """
    granted = rules.where("action = 'allow'").select("connection_id").distinct().withColumn("granted", F.lit(True))
    p = policies.join(granted, "connection_id", "left")
    verdicts = []
    for tool, reads, needs in TOOLS:
        code = F.when(~F.col("mcp_enabled"), "mcp_disabled")
        if reads:
            code = code.when(F.col("data_access") != "allowlist", "data_access_none")
        for need in needs:
            code = code.when(~F.col(need), "policy_disabled")
        if reads:
            code = code.when(F.lit(data_tools_disabled), "kill_switch").when(F.col("granted").isNull(), "table_allowlist_empty")
        verdicts.append(F.struct(F.lit(tool).alias("tool"), code.alias("reason_code"), F.lit(" and ".join(needs)).alias("needs")))
    rows = p.select("connection_id", F.explode(F.array(*verdicts)).alias("v"))
    return rows.select("connection_id", "v.tool", F.col("v.reason_code").isNull().alias("allowed"), "v.reason_code", F.when(F.col("v.reason_code") == "policy_disabled", F.col("v.needs")).alias("settings"))


def policy_violations(policies: DataFrame, rules: DataFrame, denies: DataFrame) -> DataFrame:
    """(connection_id, subject, value, violation) of what a policy must not have: too many rules, bad patterns or types, a long account name."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    good = lambda c: (F.octet_length(trimmed(c)) <= MOST_PATTERN_BYTES) & trimmed(c).rlike(r"^[\p{L}\p{N}_$#*?-]+$")
    empty = lambda c: trimmed(c) == ""

    def found(df: DataFrame, subject: str, value: str, when: F.Column, violation: str) -> DataFrame:
        return df.where(when).select("connection_id", F.lit(subject).alias("subject"), F.col(value).cast("string").alias("value"), F.lit(violation).alias("violation"))

    count = lambda df: df.groupBy("connection_id").agg(F.count("*").alias("n"))
    parts = [
        found(count(rules), "table rules", "n", F.col("n") > MOST_RULES, "too many"),
        found(count(denies), "object rules", "n", F.col("n") > MOST_RULES, "too many"),
        found(rules, "table", "table_pattern", ~good("table_pattern"), "bad pattern"),
        found(rules, "column", "column_pattern", ~empty("column_pattern") & ~good("column_pattern"), "bad pattern"),
        found(denies, "object", "name_pattern", ~good("name_pattern"), "bad pattern"),
        found(denies, "type", "object_type", (trimmed("object_type") != "*") & ~empty("object_type") & ~good("object_type"), "bad type"),
        found(policies, "account", "account", F.octet_length("account") > MOST_ACCOUNT_BYTES, "too long"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def servers_by_group(servers: DataFrame, none: str = "(no group)") -> DataFrame:
    """(grp, n, engines, servers): connections of each group, a blank one named ``none``, names in the order of their lower case; engines counts kinds."""
    grp = F.coalesce(F.nullif(F.trim("group_name"), F.lit("")), F.lit(none))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("server_name").alias("k"), F.col("server_name").alias("v")))), lambda x: x["v"])
    return servers.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.count_distinct("engine").alias("engines"), F.array_join(names, ", ").alias("servers"))


def search_servers(servers: DataFrame, text: str, fields: tuple[str, ...] = ("server_name", "engine", "group_name", "schema_name")) -> DataFrame:
    """Servers with ``text``, blind to case, in one of the fields."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(text.strip().lower()), F.lit(False))
    return servers.where(hit)


def readable_columns(columns: DataFrame, access: DataFrame, column_access: DataFrame, asked: DataFrame) -> DataFrame:
    """(connection_id, table_name, asked, column_name, verdict, n_omitted) of requests for columns of tables.

    asked: (connection_id, table_name, asked), a column's name in any case or null for all columns. A name is found exactly, else blind to case, the
    first in order. A table that can't be read, an unknown or an unreadable column is a denial; for all columns, one row of each that can
    be read, and the number left out.
    """
    keys = ["connection_id", "table_name"]
    readable = columns.join(column_access.withColumnRenamed("allowed", "readable"), [*keys, "column_name"], "left").select(*keys, "column_name", F.coalesce("readable", F.lit(False)).alias("readable"))
    table = asked.join(access.select(*keys, "allowed"), keys, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    one = table.where("allowed and asked is not null").join(readable.withColumn("low", F.lower("column_name")), [*keys], "left").where(F.col("low").isNull() | (F.col("low") == F.lower("asked")))
    best = F.min_by(F.struct("column_name", "readable"), F.struct(F.col("column_name") != F.col("asked"), "column_name"))
    named = table.where("allowed and asked is not null").join(one.groupBy(*keys, "asked").agg(best.alias("b")), [*keys, "asked"], "left")
    verdict = F.when(F.col("b.column_name").isNull(), "unknown column").when(~F.col("b.readable"), "column denied").otherwise("allowed")
    out = named.select(*keys, "asked", F.col("b.column_name").alias("column_name"), verdict.alias("verdict"), F.lit(0).cast("long").alias("n_omitted"))
    every = table.where("allowed and asked is null").join(readable, keys)
    omitted = every.groupBy(*keys).agg(F.count_if(~F.col("readable")).alias("n_omitted"))
    out = out.unionByName(every.where("readable").join(omitted, keys).select(*keys, "asked", "column_name", F.lit("allowed").alias("verdict"), "n_omitted"))
    return out.unionByName(table.where("not allowed").select(*keys, "asked", F.lit(None).cast("string").alias("column_name"), F.lit("table denied").alias("verdict"), F.lit(0).cast("long").alias("n_omitted")))


def granted_queries(requests: DataFrame, parts: DataFrame, columns: DataFrame, access: DataFrame, column_access: DataFrame, policies: DataFrame) -> DataFrame:
    """(request_id, connection_id, table_name, reason, columns, n_omitted, names, row_limit) of structured queries of tables, each judged as a whole.

    requests: (request_id, connection_id, table_name, asked_limit); parts: (request_id, part, seq, asked), the columns that a request selects
    (``column``), filters by (``filter``) or orders by (``order``); with no ``column`` it selects all that can be read, and n_omitted are left out. columns is the catalog
    (connection_id, table_name, column_name, column_id).
    A name is found exactly, else blind to case, the first in the table's order. The first fault is the reason, in this order: the table denied, not found, a
    selected column unknown or denied, none left, then filters, then order; a granted request has none. names: what each asked name stands for. Limits are within
    the connection's own, which is the default too.
    """
    keys = ["connection_id", "table_name"]
    readable = columns.join(column_access.withColumnRenamed("allowed", "readable"), [*keys, "column_name"], "left")
    readable = readable.select(*keys, "column_name", "column_id", F.lower("column_name").alias("low"), F.coalesce("readable", F.lit(False)).alias("readable"))
    every = readable.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("readable"), F.struct("column_id", "column_name")))).alias("all"), F.count_if(~F.col("readable")).alias("hidden")
    )  # one table's columns
    asked = parts.join(requests.select("request_id", *keys), "request_id").withColumns({"asked": F.trim("asked"), "low": F.lower(F.trim("asked"))})
    best = F.min_by(F.struct("column_name", "readable"), F.struct(F.col("column_name") != F.col("asked"), "column_id"))
    found = asked.join(readable, [*keys, "low"], "left").groupBy("request_id", "part", "seq", "asked").agg(best.alias("b"))
    place = F.when(F.col("part") == "column", 0).when(F.col("part") == "filter", 1).otherwise(2)
    denied = F.when(F.col("part") == "column", "column denied").when(F.col("part") == "filter", "filter denied").otherwise("order denied")
    fault = F.when(F.col("b.column_name").isNull(), F.concat(F.lit("unknown column: "), "asked")).when(~F.col("b.readable"), F.concat(denied, F.lit(": "), "b.column_name"))
    judged = found.withColumns({"place": place, "fault": fault})
    by_place = lambda when: F.min(F.when(when & F.col("fault").isNotNull(), F.struct("place", "seq", "fault")))
    selected = F.array_sort(F.collect_list(F.when(F.col("part") == "column", F.struct("seq", "b.column_name"))))
    judged = judged.groupBy("request_id").agg(
        by_place(F.col("place") == 0).alias("first"), by_place(F.col("place") > 0).alias("later"), selected.alias("selected"),
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("asked", "b.column_name")))).alias("names"),
    )
    rows = requests.join(judged, "request_id", "left").join(every, keys, "left").join(access.select(*keys, "allowed"), keys, "left").join(few(policies.select("connection_id", "max_rows")), "connection_id", "left")
    own = F.coalesce(F.size("selected") > 0, F.lit(False))
    name = lambda c: F.transform(c, lambda x: x["column_name"])
    chosen = F.when(own, name("selected")).otherwise(name("all"))
    reason = F.when(~F.coalesce("allowed", F.lit(False)), "table denied").when(F.col("all").isNull(), "table not found").when(F.col("first").isNotNull(), F.col("first.fault"))
    rows = rows.withColumn("reason", reason.when(F.size(chosen) == 0, "no column may be read").otherwise(F.col("later.fault")))
    most = F.greatest(F.lit(1), F.least(F.lit(MOST_ROWS), F.coalesce("max_rows", F.lit(DEFAULT_ROWS))))
    granted = F.col("reason").isNull()
    return rows.select(
        "request_id", *keys, "reason", F.when(granted, chosen).alias("columns"), F.when(granted & ~own, F.col("hidden")).otherwise(F.lit(0)).cast("long").alias("n_omitted"),
        F.when(granted, F.coalesce("names", F.expr("cast(map() as map<string, string>)"))).alias("names"), F.when(granted, F.greatest(F.lit(1), F.least(most, F.coalesce("asked_limit", most)))).cast("int").alias("row_limit"),
    )


def access_summary(objects: DataFrame, policies: DataFrame, rules: DataFrame, denies: DataFrame, servers: DataFrame, data_tools_disabled: bool = False) -> DataFrame:
    """(connection_id, n_hidden, n_allowed, n_restricted, n_denied, n_other, tools) of each connection with a policy: what an agent would see and may use.

    Objects (server_id, name, object_type) count only where the agent is let in and may list them: those that rules hide, then relations by how their
    data can be read, and others. tools names the allowed ones, in the order of their names.
    """
    listing = few(policies.where("mcp_enabled and allow_schema_list").select("connection_id"))
    own = objects.select(F.col("server_id").alias("connection_id"), "name", "object_type").join(listing, "connection_id", "left_semi")
    shown = hide_objects(own, denies, "connection_id")
    relation = F.col("object_type").isin("TABLE", "VIEW", "MATERIALIZED VIEW")
    access = table_access(shown.where(relation).select("connection_id", F.col("name").alias("table_name")).distinct(), policies, rules, servers)
    judged = shown.join(access.withColumnRenamed("table_name", "name"), ["connection_id", "name"], "left")
    allowed, restricted = F.coalesce("allowed", F.lit(False)), F.coalesce("column_rules", F.lit(False))
    counts = judged.groupBy("connection_id").agg(
        F.count("*").alias("n_shown"), F.count_if(relation & allowed & ~restricted).alias("n_allowed"), F.count_if(relation & allowed & restricted).alias("n_restricted"),
        F.count_if(relation & ~allowed).alias("n_denied"), F.count_if(~relation).alias("n_other"),
    )
    held = own.groupBy("connection_id").agg(F.count("*").alias("n_held"))
    tools = capability_matrix(policies, rules, data_tools_disabled).groupBy("connection_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("allowed"), F.col("tool")))), " ").alias("tools"))
    rows = tools.join(held, "connection_id", "left").join(counts, "connection_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("connection_id", (zero("n_held") - zero("n_shown")).alias("n_hidden"), *(zero(c).alias(c) for c in ("n_allowed", "n_restricted", "n_denied", "n_other")), "tools")
