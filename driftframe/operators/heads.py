"""Heads of statements, read token by token: words and quoted names, folded through a table of states.

A table says, for a state and a word, which state comes next and whether the word is part of the kind. A word that the table does not know
is a name where the state allows one, else the text has no such head.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token with the white space before it: a quoted name, a run of name characters, or a point. A head has at most MOST_TOKENS.
_TOKEN = r'\s*(?:"[^"]*"|[A-Za-z0-9_$#]+|\.)'
MOST_TOKENS = 64

# Words of heads that name a kind of object, that may stand before these, and that change what a statement means.
KINDS = ("TABLE", "INDEX", "VIEW", "PACKAGE", "TYPE", "SEQUENCE", "PROCEDURE", "FUNCTION", "TRIGGER", "SYNONYM")
BEFORE_KINDS = ("GLOBAL", "TEMPORARY", "PRIVATE", "UNIQUE", "BITMAP", "MATERIALIZED", "PUBLIC")
MODIFIERS = ("NONEDITIONABLE", "FORCE", "NOFORCE", "EDITIONING")
SECTIONS = ("target data source", "target", "table")

Table = dict[tuple[str, str], tuple[str, bool]]


def _object_words(state: str, after: str) -> Table:
    """Kinds from ``state`` on; a package or type may be followed by its body."""
    return {(state, k): ("body" if k in ("PACKAGE", "TYPE") else after, True) for k in KINDS} | {("body", "BODY"): (after, True)}


def _canonical_table() -> Table:
    table: Table = {("start", "CREATE"): ("words", False), ("words", "OR"): ("or", False), ("or", "REPLACE"): ("words", False), ("words", "EDITIONABLE"): ("words", False)}
    table |= {("words", m): ("words", True) for m in MODIFIERS}
    for state in ("words", "kind"):
        table |= {(state, w): ("kind", True) for w in BEFORE_KINDS} | _object_words(state, "name")
    return table


def _outline_table() -> Table:
    """Each optional word may be left out, so a state also has what may come after it."""
    table: Table = {("start", "CREATE"): ("created", False), ("created", "OR"): ("or", False), ("or", "REPLACE"): ("replaced", False)}
    for state in ("created", "replaced"):
        table |= {(state, w): ("edition", False) for w in ("EDITIONABLE", "NONEDITIONABLE")}
    for state in ("created", "replaced", "edition"):
        table |= {(state, w): ("kind", False) for w in ("TEMPORARY", "UNIQUE", "MATERIALIZED")} | {(state, "GLOBAL"): ("global", False)}
    table |= {("global", "TEMPORARY"): ("kind", False)}
    for state in ("created", "replaced", "edition", "kind"):
        table |= _object_words(state, "maybe")
    for state in ("maybe", "body"):
        table |= {(state, "IF"): ("if", False)}
    table |= {("if", "NOT"): ("not", False), ("not", "EXISTS"): ("name", False), ("start", "ALTER"): ("alter", True), ("alter", "TABLE"): ("name", True)}
    return table | {("start", k): ("name", True) for k in ("PROCEDURE", "FUNCTION")}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


CANONICAL, OUTLINE = _canonical_table(), _outline_table()
#: States in which a word that the table does not know is the name.
NAMING = ("name", "body", "maybe")


def _scan(c: Column, table: Table, spaced: bool) -> Column:
    """(state, words, first, second, used, spare) of the head of a text.

    words: those of the kind, in upper case; first and second: parts of the name as they stand; used: characters up to the name's end; spare:
    a word that the table took for its own, which is the name if nothing else is. The state is "first" or "second" after a whole name.
    spaced: white space stands before each word and name.
    """
    known = F.create_map(*(x for (state, word), (then, kept) in table.items() for x in (F.lit(f"{state} {word}"), F.struct(F.lit(then).alias("then"), F.lit(kept).alias("kept")))))
    start = F.struct(F.lit("start").alias("state"), F.array().cast("array<string>").alias("words"), F.lit("").alias("first"), F.lit("").alias("second"), F.lit(0).alias("used"), F.lit("").alias("spare"))

    def step(s: Column, token: Column) -> Column:
        return _let(F.element_at(known, F.concat(s["state"], F.lit(" "), token["word"])), lambda entry: move(s, token, entry))

    def move(s: Column, token: Column, entry: Column) -> Column:
        raw, glued, word, state = token["raw"], token["glued"], token["word"], s["state"]
        apart = ~glued | (state == "start") if spaced else F.lit(True)
        used = s["used"] + token["size"]

        def to(then: Column | str, words: Column | None = None, first: Column | None = None, second: Column | None = None, at: Column | None = None, spare: Column | None = None) -> Column:
            given = lambda x, name: s[name] if x is None else x
            return F.struct((F.lit(then) if isinstance(then, str) else then).alias("state"), given(words, "words").alias("words"), given(first, "first").alias("first"), given(second, "second").alias("second"), given(at, "used").alias("used"), given(spare, "spare").alias("spare"))

        name = raw.startswith('"') & (F.length(raw) > 2) | raw.rlike(r"^[A-Za-z0-9_$#]" if spaced else r"^[A-Za-z]")
        kept = F.when(entry["kept"], F.concat(s["words"], F.array(word))).otherwise(s["words"])
        mine = F.when(word.isin("IF", "BODY"), raw).otherwise(s["spare"])
        out = F.when(state.isin("second", "none"), s)
        out = out.when(state == "first", F.when(glued & (raw == "."), to("point")).otherwise(to("none")))
        out = out.when(state == "point", F.when(glued & name & (raw != "."), to("second", second=raw, at=used + 1)).otherwise(to("none")))
        out = out.when(entry.isNotNull() & apart, to(entry["then"], words=kept, at=used, spare=mine))
        out = out.when(state.isin(*NAMING) & name & apart, to("first", first=raw, at=used))
        return out.otherwise(to("none"))

    tokens = F.regexp_extract_all(F.regexp_extract(c, rf"^(?:{_TOKEN}){{0,{MOST_TOKENS}}}", 0), F.lit(_TOKEN), 0)

    def read(x: Column) -> Column:
        return _let(F.regexp_replace(x, r"^\s+", ""), lambda raw: F.struct(raw.alias("raw"), F.upper(raw).alias("word"), (F.length(raw) == F.length(x)).alias("glued"), F.length(x).alias("size")))

    return F.aggregate(F.transform(tokens, read), start, step)


def _canonical_part(raw: Column) -> Column:
    """A name's part: upper case, unless it is quoted and would read otherwise without quotes."""
    inside = F.substring(raw, F.lit(2), F.length(raw) - 2)
    return F.when(raw.startswith('"'), F.when(inside.rlike(r"^[A-Z][A-Z0-9_$#]*$"), inside).otherwise(raw)).otherwise(F.upper(raw))


def canonical_header(c: str | Column, schema: str) -> Column:
    """``CREATE <words> <name>`` in one spelling, so that definitions of one object compare equal; texts with another head stay as they are.

    Case and white space of words, OR REPLACE, EDITIONABLE, the own schema, and quotes that change nothing don't count. Words that
    differ in meaning (NONEDITIONABLE, FORCE, ...), other schemas and names that need their quotes stay. After the name only the
    spacing and the case of AS or IS are changed.
    """
    c = F.col(c) if isinstance(c, str) else c
    return _let(_scan(c, CANONICAL, spaced=False), lambda s: _canonical(c, s, schema))


def _canonical(c: Column, s: Column, schema: str) -> Column:
    both = s["second"] != ""
    own = F.upper(F.regexp_replace(s["first"], '"', "")) == schema.strip().upper()
    name = F.when(both & own, _canonical_part(s["second"])).when(both, F.concat(_canonical_part(s["first"]), F.lit("."), _canonical_part(s["second"]))).otherwise(_canonical_part(s["first"]))
    rest = F.ltrim(F.substring(c, s["used"] + 1, F.length(c)), F.lit(" \t"))
    word = F.regexp_extract(rest, r"^[A-Za-z]*", 0)
    rest = F.when(F.upper(word).isin("AS", "IS"), F.concat(F.upper(word), F.substring(rest, F.length(word) + 1, F.length(rest)))).otherwise(rest)
    rest = F.when((rest == "") | rest.startswith("\n"), rest).otherwise(F.concat(F.lit(" "), rest))
    dangling = F.substring(c, s["used"] + 1, F.lit(1)) == "."
    whole = s["state"].isin("first", "second") | ((s["state"] == "none") & (s["first"] != "") & ~dangling)
    return F.when(whole, F.concat(F.lit("CREATE "), F.array_join(s["words"], " "), F.lit(" "), name, rest)).otherwise(c)


def line_head(line: str | Column) -> Column:
    """(kind, name) of a line that begins a statement, subprogram or section of a script, else null; only lines with a first word of one are folded."""
    line = F.col(line) if isinstance(line, str) else line
    begins = "|".join(sorted({word for state, word in OUTLINE if state == "start"}))
    text = F.trim(line, F.lit(" \t\n\r\x0b\f"))
    label = F.split(F.ltrim(F.substring(text, F.lit(3), F.length(text)), F.lit(" \t")), ":", 2)
    value = F.trim(F.element_at(label, F.lit(-1)), F.lit(" \t\r"))
    section = text.startswith("--") & (F.size(label) == 2) & F.lower(F.element_at(label, 1)).isin(*SECTIONS) & (value != "")
    head = F.when(line.rlike(rf"(?i)^\s*(?:{begins})\s"), _let(_scan(line, OUTLINE, spaced=True), _named))
    return F.when(section, F.struct(F.upper(F.element_at(label, 1)).alias("kind"), value.alias("name"))).otherwise(head)


def _named(s: Column) -> Column:
    name = F.when(s["second"] != "", F.concat(s["first"], F.lit("."), s["second"])).when(s["first"] != "", s["first"]).otherwise(s["spare"])
    words = F.when((s["first"] == "") & (F.upper(s["spare"]) == "BODY"), F.slice(s["words"], 1, F.size(s["words"]) - 1)).otherwise(s["words"])  # the body is what is named
    return F.when((F.size(words) > 0) & (name != ""), F.struct(F.array_join(words, " ").alias("kind"), name.alias("name")))


def clean_code(c: str | Column) -> Column:
    """A code object's definition as ``CREATE OR REPLACE``, its head without (NON)EDITIONABLE and without quotes of the name's first part; the body stays.

    Words keep their case; a text that is no such statement is only trimmed.
    """
    c = F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\f"))
    return _let(_scan(c, CANONICAL, spaced=False), lambda s: _cleaned(c, s))


def _cleaned(c: Column, s: Column) -> Column:
    words = F.filter(s["words"], lambda w: ~w.isin("NONEDITIONABLE"))
    first = F.regexp_replace(s["first"], '"', "")
    name = F.when(s["second"] != "", F.concat(first, F.lit("."), s["second"])).otherwise(first)
    head = F.concat(F.lit("CREATE OR REPLACE "), F.array_join(words, " "), F.lit(" "), name)
    return F.when(s["first"] != "", F.concat(head, F.substring(c, s["used"] + 1, F.length(c)))).otherwise(c)


#: Words of a sequence's definition that say what holds anyway.
SEQUENCE_NOISE = ("NOORDER", "NOCYCLE", "NOKEEP", "NOSCALE", "GLOBAL")


def clean_sequence(c: str | Column) -> Column:
    """A sequence's definition without its schema, words that say what holds anyway, and double spaces; it starts with 1."""
    c = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[;\s]+$", "")
    tokens = F.regexp_extract_all(c, F.lit(r'\s*(?:"[^"]*"(?:\."[^"]*")*|[^\s"]+)'), 0)
    word = lambda x: F.upper(F.trim(x, F.lit(" \t\n\r")))
    told = F.filter(tokens, lambda x: ~word(x).isin(*SEQUENCE_NOISE))
    lead = lambda x: F.regexp_extract(x, r"^\s*", 0)
    last = lambda x: F.element_at(F.split(x, r"\."), -1)

    def token(x: Column, i: Column) -> Column:
        before = lambda k: word(F.coalesce(F.get(told, i - k), F.lit("")))
        named = (i == 2) & (before(2) == "CREATE") & (before(1) == "SEQUENCE") & x.contains('"."')
        seeded = (before(2) == "START") & (before(1) == "WITH") & word(x).rlike("^[0-9]+$")
        return F.when(named, F.concat(lead(x), F.regexp_replace(last(x), '"', ""))).when(seeded, F.concat(lead(x), F.lit("1"))).otherwise(x)

    return F.trim(F.regexp_replace(F.array_join(F.transform(told, token), ""), " {2,}", " "))


def clean_definition(c: str | Column, kind: str | Column) -> Column:
    """A definition as a script has it: code objects and synonyms as ``CREATE OR REPLACE``, sequences cleaned, others only trimmed."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    text = F.col(c) if isinstance(c, str) else c
    code = kind.isin("VIEW", "PROCEDURE", "FUNCTION", "PACKAGE", "PACKAGE BODY", "TYPE", "TYPE BODY", "SYNONYM", "TRIGGER")
    return F.when(code, clean_code(text)).when(kind == "SEQUENCE", clean_sequence(text)).otherwise(F.trim(text, F.lit(" \t\n\r\x0b\f")))


def not_null_column(condition: str | Column) -> Column:
    """The column of a condition that only says that it is not null, else an empty text."""
    c = F.col(condition) if isinstance(condition, str) else condition
    parts = F.split(F.trim(c, F.lit(" \t\n\r")), r"\s+")
    bare = F.regexp_replace(F.element_at(parts, 1), '^"|"$', "")
    says = (F.size(parts) == 4) & (F.lower(F.array_join(F.slice(parts, 2, 3), " ")) == "is not null") & bare.rlike(r"^[A-Za-z0-9_$#]+$")
    return F.when(says, bare).otherwise("")
