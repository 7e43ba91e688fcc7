"""Phrase collocations, from counts of all phrases of two to four words in weighted acyclic automata.

Words that come often enough get ids. Each group of texts counts its phrases of such words, in order, builds one automaton for each
range of beginnings, and sends these; a range unites the automata of all groups and sums their weights. What stays below the least count
goes. The parts of a phrase are looked up by composing their paths with automata of the remaining phrases, range by range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import HOT_KEYS, HOT_LEAST, group_count, materialize
from .count_automata import Levels, Lookup, union

#: Least count of a phrase; a phrase inside a longer one that has so much of its count, in percent, goes.
LEAST = 30
WITHIN = 80
#: Phrases of each language.
TOP = 2_000
SCALE = 2_000_000
NO_LANG = "und"
#: Tokens whose phrases a range of beginnings holds, on average; a first word with more is divided by the words after it.
RANGE_TOKENS = 1 << 21
#: Parts that are looked up in one task.
PARTS_AT_ONCE = 1 << 18

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _words(texts: pa.ChunkedArray, weight: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts, whether each follows the one before in a piece, its text's number, and its weight."""
    data, offsets = K.buffers(texts)
    data, offsets = K.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0]
    ink = ~_GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # where a word or a gap begins
    edge[1:-1] = ink[1:] != ink[:-1]
    edge[0] = edge[-1] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    worded = ink[start] if len(data) else np.zeros(len(start), bool)
    start, end = start[worded], end[worded]
    text = np.searchsorted(offsets, start, side="right") - 1
    breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), start)
    linked = np.zeros(len(start), dtype=bool)
    linked[1:] = (breaks[1:] == breaks[:-1]) & (text[1:] == text[:-1])
    size = np.concatenate([[0], np.cumsum(end - start)])
    column = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[ink].tobytes()))
    return column.dictionary_encode(), linked, text, weight[text]


def _by_language(table: pa.Table):
    """(language, its words, links, weights) of a group."""
    table = table.sort_by("lang")
    lang = table.column("lang").to_pylist()
    cuts = [i for i in range(len(lang)) if not i or lang[i] != lang[i - 1]] + [len(lang)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = table.slice(a, b - a)
        words, linked, _, weight = _words(own.column("text"), own.column("times").to_numpy())
        yield lang[a], words, linked, weight


WORDS = "g long, lang string, word string, n long"


def _count_words(table: pa.Table) -> pa.Table:
    """Distinct words of a group."""
    g, out = table.column("g")[0].as_py(), []
    for lang, words, _, weight in _by_language(table):
        n = len(words.dictionary)
        counts = np.bincount(words.indices.to_numpy(), weights=weight, minlength=n).astype(np.int64)
        out.append(pa.table([pa.array([g] * n, pa.int64()), pa.array([lang] * n, pa.string()), words.dictionary.cast(pa.string()), pa.array(counts)], names=["g", "lang", "word", "n"]))
    K.release()
    return pa.concat_tables(out)


AUTOMATA = "bucket long, automaton binary"


def _mixed(*ids: np.ndarray) -> np.ndarray:
    total = np.zeros(len(ids[0]), dtype=np.uint64)
    for x in ids:
        total = K.mix(total * K.U64(31) + x.astype(np.uint64))
    return total


def _automata(ranges: int):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        """For each range of beginnings, the automaton of the group's phrases."""
        rows: list[tuple[int, bytes]] = []
        if not len(known) or not len(texts):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=["bucket", "automaton"])
        tokens, links, weights = [], [], []
        known = known.sort_by("id")
        ids, splits = known.column("id").to_numpy(), known.column("splits").to_numpy()
        for lang, words, linked, weight in _by_language(texts):
            own = np.flatnonzero(pc.equal(known.column("lang"), lang).to_numpy(zero_copy_only=False))
            found = pc.index_in(words.dictionary, known.column("word").take(pa.array(own)).cast(pa.large_string()).combine_chunks())
            place = found.fill_null(-1).to_numpy()
            tokens.append(np.where(place >= 0, own[place] if len(own) else -1, -1)[words.indices.to_numpy()])
            links.append(linked)
            weights.append(weight)
        tree = Levels.of_tokens(np.concatenate(tokens), np.concatenate(links), np.concatenate(weights))
        del tokens, links, weights
        first, second = tree.parents[0], tree.words[0]
        base, several = _mixed(ids), splits.astype(np.uint64)
        pair = (base[first] + _mixed(ids[second]) % several[first]) % K.U64(ranges)
        up = tree.parents[1]
        triple = (base[first[up]] + _mixed(ids[second[up]], ids[tree.words[1]]) % several[first[up]]) % K.U64(ranges)
        triple = np.where(several[first[up]] > 1, triple, pair[up])
        rows += tree.automata(pair.astype(np.int64), triple.astype(np.int64), ids)
        K.release()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "automaton"])

    return run


PHRASES = "w1 long, w2 long, w3 long, w4 long, f long"


def _phrases(table: pa.Table) -> pa.Table:
    """The phrases of a range that come often enough."""
    tree, ids = union(table.column("automaton").to_pylist())
    ids = np.append(ids, -1)
    none = lambda n: np.full(n, -1)
    out = [[], [], [], [], []]
    a, b = tree.parents[0], tree.words[0]
    paths = [(a, b), (a[tree.parents[1]], b[tree.parents[1]], tree.words[1])]
    up = tree.parents[2]
    paths.append((*(x[up] for x in paths[1]), tree.words[2]))
    for path, count in zip(paths, tree.counts, strict=True):
        often = np.flatnonzero(count >= LEAST)
        for k in range(4):
            out[k].append(ids[path[k][often]] if k < len(path) else none(len(often)))
        out[4].append(count[often])
    K.release()
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "w3", "w4", "f"])


PART = ["p1", "p2", "p3"]
ANSWERS = "w1 long, w2 long, w3 long, w4 long, a long, kind string, k int, f long, word string, lang string"


def _look_up(parts: pa.Table, wanted: pa.Table) -> pa.Table:
    """What is wanted in a range, with count, word and language of the part."""
    rows = lambda t: np.stack([t.column(c).to_numpy() for c in PART], axis=1) if len(t) else np.zeros((0, 3), np.int64)
    found = Lookup(rows(parts)).compose(rows(wanted))
    if (found < 0).any():
        raise AssertionError("a phrase has a part that was not counted")
    of = parts.take(pa.array(found))
    columns = [wanted.column(c) for c in ("w1", "w2", "w3", "w4", "a", "kind", "k")] + [of.column(c) for c in ("f", "word", "lang")]
    return pa.table(columns, names=[c.split()[0] for c in ANSWERS.split(", ")])


def _wanted(phrases: DataFrame) -> DataFrame:
    """The first and second part of each cut of each phrase, and each of its words."""
    none = F.lit(-1).cast("long")
    w = [F.col(f"w{k}") for k in (1, 2, 3, 4)]

    def part(kind: str, k: int, words: list[Column]) -> Column:
        own = [*words, none, none][:3]
        return F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"), *(x.alias(p) for x, p in zip(own, PART, strict=True)))

    cuts = [x for k in (1, 2, 3) for x in (part("first", k, w[:k]), part("rest", k, w[k:]))]
    words = [part("word", k, [w[k - 1]]) for k in (1, 2, 3, 4)]
    size = F.when(w[2] < 0, 2).when(w[3] < 0, 3).otherwise(4)
    real = lambda x: F.when(x["kind"] == "word", x["k"] <= size).otherwise(x["k"] < size)
    return phrases.select("w1", "w2", "w3", "w4", F.col("f").alias("a"), F.explode(F.filter(F.array(*cuts, *words), real)).alias("x")).select("w1", "w2", "w3", "w4", "a", "x.*")


def _answers(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """Counts, words and languages of all parts of ``phrases``; a part that very many phrases have is looked up in several tasks."""
    wanted = materialize(_wanted(phrases), "parts", compact=False)
    total = wanted.count()
    ranges = group_count(total, PARTS_AT_ONCE)
    often = wanted.groupBy(*PART).agg(F.count("*").alias("n")).where(F.col("n") * HOT_KEYS > max(total, HOT_LEAST * HOT_KEYS))
    hot = F.broadcast(materialize(often.select(*PART, F.ceil(F.col("n") / PARTS_AT_ONCE).alias("salts")), "hot-parts"))  # HOT_KEYS at most
    salts = F.coalesce("salts", F.lit(1))
    dealt = lambda t: t.withColumn("range", F.pmod(F.xxhash64(*PART, "salt"), F.lit(ranges))).groupBy("range")
    left = parts.join(hot, PART, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    right = wanted.join(hot, PART, "left").withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3", "w4"), salts)).drop("salts")
    return dealt(left.dropDuplicates([*PART, "salt"])).cogroup(dealt(right)).applyInArrow(_look_up, ANSWERS)


def _outermost(phrases: DataFrame) -> DataFrame:
    """Without phrases inside a longer one that has most of their count."""
    w = [F.col(f"w{k}") for k in (1, 2, 3, 4)]
    none = F.lit(-1).cast("long")
    inner = lambda words: F.struct(*(x.alias(f"w{k}") for k, x in enumerate([*words, none, none][:4], 1)))
    inside = F.when(w[3] >= 0, F.array(inner(w[:3]), inner(w[1:]), inner(w[:2]), inner(w[1:3]), inner(w[2:]))).otherwise(F.array(inner(w[:2]), inner(w[1:3])))
    around = phrases.where("w3 >= 0").select("f", F.explode(inside).alias("x")).groupBy("x.w1", "x.w2", "x.w3", "x.w4").agg(F.max("f").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = F.col("around").isNull() | (wide("around") * 100 < wide("f") * WITHIN)
    return phrases.join(around, ["w1", "w2", "w3", "w4"], "left").where(kept).drop("around")


def top_of_each(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """With ``rank``, the first n rows of each key; parts of a key are cut to n by themselves first, so no task sorts a whole key."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order))).where(F.col("rank") <= n)
    return some.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def collocations(documents: DataFrame) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first phrases of each language of ``documents`` (text, lang, ...).

    A null lang is ``und``. Null and empty texts have no words; very long ones are counted whole; texts that repeat are counted as
    often as they come, but worked on once. Phrases that tie in score and count come in byte order. An empty table, or one without a phrase
    that comes often enough, gives no rows. Ids are not read; other columns are ignored, whatever their names.
    """
    named = documents.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text").where("text <> ''")
    once = materialize(named.groupBy("lang", "text").agg(F.count("*").alias("times")), "texts", compact=False)
    groups = group_count(once.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    by_group = once.withColumn("g", F.pmod(F.xxhash64("lang", "text"), F.lit(groups)))
    words = materialize(by_group.groupBy("g").applyInArrow(_count_words, WORDS), "words", compact=False)
    lengths = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= LEAST)
    often = materialize(often.withColumn("id", F.monotonically_increasing_id()).withColumn("splits", F.ceil(F.col("f") / RANGE_TOKENS)), "vocabulary")
    known = words.drop("n").join(often.drop("f"), ["lang", "word"])
    total = often.agg(F.sum("f").alias("n")).first()["n"] or 0
    automata = by_group.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(_automata(group_count(total, RANGE_TOKENS)), AUTOMATA)
    phrases = materialize(automata.groupBy("bucket").applyInArrow(_phrases, PHRASES), "phrases")
    one = [F.lit(-1).cast("long").alias(p) for p in PART[1:]]
    parts = phrases.where("w4 < 0").select(*(F.col(f"w{k}").alias(p) for k, p in enumerate(PART, 1)), "f", F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("lang"))
    parts = parts.unionByName(often.select(F.col("id").alias("p1"), *one, "f", "word", "lang"))
    answers = _answers(_outermost(phrases), parts)
    only = lambda kind, k, x: F.max(F.when((F.col("kind") == kind) & (F.col("k") == k), F.col(x)))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    columns = [only(kind, k, "f").alias(f"{kind}{k}") for kind in ("first", "rest") for k in (1, 2, 3)] + [only("word", k, "word").alias(f"word{k}") for k in (1, 2, 3, 4)]
    whole = answers.groupBy("w1", "w2", "w3", "w4", "a").agg(*columns, only("word", 1, "lang").alias("lang"))
    scored = whole.select("*", *(F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) div (CAST(first{k} AS DECIMAL(20,0)) + CAST(rest{k} AS DECIMAL(20,0)))").alias(f"score{k}") for k in (1, 2, 3)))
    cuts = [F.when(F.col(f"score{k}").isNotNull(), F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("k"), F.col(f"first{k}").alias("l"), F.col(f"rest{k}").alias("r"))) for k in (1, 2, 3)]
    best = F.array_min(F.array(*cuts))  # nulls are left out
    rows = scored.select("lang", F.concat_ws(" ", "word1", "word2", "word3", "word4").alias("phrase"), "a", best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    top = top_of_each(rows, "lang", TOP, F.desc("score"), F.desc("a"), F.col("phrase"))
    return top.join(lengths, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM q, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE len(w) >= len),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM g WHERE len = 1 GROUP BY lang),
f AS (SELECT lang, len, phrase, count(*) AS a FROM g GROUP BY lang, len, phrase HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len >= 2),
inside AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS around FROM
 (SELECT lang, a, w, k, unnest(range(1, len - k + 2)) AS i FROM (SELECT lang, a, len, string_split(phrase, ' ') AS w, unnest(range(2, len)) AS k FROM c WHERE len >= 3)) GROUP BY 1, 2),
k AS (SELECT c.* FROM c LEFT JOIN inside i USING (lang, phrase) WHERE i.around IS NULL OR 100 * i.around::HUGEINT < 80 * c.a::HUGEINT),
cut AS (SELECT lang, phrase, a, len, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, len)) AS k FROM k)),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.a AS l, y.a AS r, CAST((2000000 * cut.a::HUGEINT) // (x.a::HUGEINT + y.a::HUGEINT) AS BIGINT) AS score FROM cut
 JOIN f x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n USING (lang) WHERE o.rank <= 2000
"""
