"""Removal of repeated line runs by a suffix array over line-ID sequences, built by distributed prefix doubling.

All documents' lines with a word, in the order of (doc_id, line), are one text of line IDs; suffixes end with their document.
Lines that occur once end every repeated run, so only the others have a rank. Prefix doubling gives each position the ranks of its
next 1, 2, 4, ... lines: its prefix and that of the position so many lines later. The distinct prefixes in order, cut into ranges of
equal size, are the suffix array; the longest common prefix (LCP) of each with the one before it gives the LCP intervals:
neighbours that share a prefix of some length. The first position of an interval is the run's first occurrence; at each other
position the longest interval that begins earlier is its maximal repeated run, a later copy, deleted if it has enough words.

Every line has a word, so runs of ``min_words`` lines have enough, and longer ones consist of such: ranks are doubled and
LCPs counted to ``min_words`` lines, beyond which nothing is decided otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import look_up, materialize, texts

#: Words that a copied run must have to be deleted.
MIN_WORDS = 5
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["doc_id", "h"]


def _ordered(distinct: DataFrame, *columns: str) -> DataFrame:
    """With ``rank``, increasing in the order of ``columns``: ranges of equal size are sorted each by itself; a rank's upper bits are its range."""
    ranges = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns).withColumn("rank", F.monotonically_increasing_id())


def _line_positions(documents: DataFrame) -> DataFrame:
    """(doc_id, h, line, n, before, upto, a, b) of lines with a word: number among them, words before the line and to its end, 128-bit ID.

    h is a hash of the text, so that other texts with one doc_id are other documents; a row that comes again counts once.
    """
    docs = texts(documents).where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    worded = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("line", "body")).withColumn("words", F.regexp_count("body", F.lit(WORD))).where("words > 0")
    ids = worded.select(*DOC, "line", "words", F.xxhash64("body").alias("a"), F.xxhash64(F.lit(1), "body").alias("b"))
    order = Window.partitionBy(*DOC).orderBy("line")
    ids = ids.withColumn("last", F.lag("line").over(order)).where("last is null or last < line").drop("last")
    ids = ids.withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return materialize(ids.withColumn("before", F.col("upto") - F.col("words")).drop("words"), "lines", compact=False)


def _prefixes(ids: DataFrame, depth: int) -> DataFrame:
    """(doc_id, h, n, before, prefix, ends): for each repeated line the ranks of it and the next, ``depth`` at most, and the words to the end of each."""
    lines = ids.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1")
    lines = materialize(_ordered(lines, "a", "b"), "line-ranks")
    level = look_up(ids, lines, ["a", "b"], "times").select(*DOC, "n", "before", F.array("rank").alias("prefix"), F.array("upto").alias("ends"))
    level, length = materialize(level, "prefixes"), 1
    while length < depth:
        ahead = level.select(*DOC, (F.col("n") - length).alias("n"), F.col("prefix").alias("next"), F.col("ends").alias("next_ends"))
        both = level.join(ahead, [*DOC, "n"], "left")
        longer = lambda own, more: F.when((F.size("prefix") == length) & F.col(more).isNotNull(), F.slice(F.concat(own, more), 1, depth)).otherwise(F.col(own))
        level = materialize(both.select(*DOC, "n", "before", longer("prefix", "next").alias("prefix"), longer("ends", "next_ends").alias("ends")), "prefixes")
        length *= 2
    return level


def _suffix_array(prefixes: DataFrame, depth: int) -> DataFrame:
    """(rank, prefix, times, first, lcp): distinct prefixes in order, with their first position (doc_id, h, n) and the LCP with the one before."""
    classes = prefixes.groupBy("prefix").agg(F.count("*").alias("times"), F.min(F.struct(*DOC, "n")).alias("first"))
    classes = materialize(_ordered(classes, "prefix"), "suffixes").withColumn("range", F.shiftright("rank", 33))
    # the prefix before the first of a range is the last of a range before: one row for each range
    tails = classes.groupBy("range").agg(F.max_by("prefix", "rank").alias("tail")).withColumn("tail", F.lag("tail").over(Window.orderBy("range")))
    own = F.lag("prefix").over(Window.partitionBy("range").orderBy("rank"))
    found = classes.withColumn("own", own).join(F.broadcast(tails), "range").withColumn("previous", F.coalesce("own", "tail"))
    same = lambda k: F.get("prefix", F.lit(k)) == F.get("previous", F.lit(k))
    lcp = F.lit(depth)
    for k in reversed(range(depth)):
        lcp = F.when(F.coalesce(same(k), F.lit(False)), lcp).otherwise(k)
    return materialize(found.select("range", "rank", "prefix", "times", "first", lcp.alias("lcp")), "suffix-array")


def _interval_starts(array: DataFrame, depth: int) -> DataFrame:
    """``array`` with ``starts``: for each length, the rank at which the suffix's LCP interval of that length begins."""
    heads = [F.max(F.when(F.col("lcp") < k, F.col("rank"))) for k in range(1, depth + 1)]
    # an interval may begin in an earlier range; these are one row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = array.groupBy("range").agg(*(h.alias(f"h{k}") for k, h in enumerate(heads)))
    carried = carried.select("range", F.array(*(F.max(f"h{k}").over(before) for k in range(depth))).alias("carried"))
    running = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.array(*(h.over(running) for h in heads))
    return array.withColumn("own", own).join(F.broadcast(carried), "range").withColumn("starts", F.zip_with("own", "carried", lambda a, b: F.coalesce(a, b))).drop("own", "carried")


def _earliest(array: DataFrame, depth: int) -> DataFrame:
    """(prefix, times, earliest): for each distinct prefix, the first position of each LCP interval that holds it, by length from 1."""
    placed = materialize(_interval_starts(array, depth), "intervals")
    member = placed.select("rank", "first", "times", F.posexplode("starts").alias("at", "start")).where(F.col("at") < F.size("prefix"))
    firsts = materialize(member.groupBy("at", "start").agg(F.min("first").alias("first"), F.count("*").alias("members")), "interval-firsts")
    found = look_up(member.select("rank", "at", "start"), firsts, ["at", "start"], "members").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("firsts"))
    return materialize(placed.join(found, "rank").select("prefix", "times", F.transform("firsts", lambda x: x["first"]).alias("earliest")), "earliest")


def copied_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, line): lines, counted from 0, that later copies of maximal repeated runs of ``min_words`` words or more cover."""
    depth = max(1, min_words)
    ids = _line_positions(documents)
    prefixes = _prefixes(ids, depth)
    classes = _earliest(_suffix_array(prefixes, depth), depth)
    held = look_up(prefixes, classes, ["prefix"], "times")
    # intervals of longer prefixes begin no earlier, so the maximal run is as long as the earliest positions before this one are many
    length = F.size(F.filter("earliest", lambda first: first < F.struct(*DOC, "n")))
    found = held.withColumn("length", length).where((F.col("length") > 0) & (F.get("ends", F.col("length") - 1) - F.col("before") >= min_words))
    covered = found.select(*DOC, F.explode(F.sequence("n", F.col("n") + F.col("length") - 1)).alias("n")).distinct()
    return covered.join(ids.select(*DOC, "n", "line"), [*DOC, "n"]).select(*DOC, "line")


def _copied_runs(documents: DataFrame, min_words: int) -> DataFrame:
    """(__id, __h, __runs): unbroken deleted lines of each text that has any, as (first, last) in order."""
    run = F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line"))
    runs = copied_lines(documents, min_words).withColumn("run", run).groupBy(*DOC, "run").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return materialize(runs.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__runs")), "line-runs")


def _kept_text() -> F.Column:
    """The column __text without the lines of __runs."""
    lines, runs = F.split("__text", "\n"), F.col("__runs")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, i - 1)["last"] + 1)
    stop = lambda i: F.coalesce(F.get(runs, i)["first"], F.size(lines))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda i: F.slice(lines, start(i) + 1, stop(i) - start(i))))
    return F.when(runs.isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))


def remove_repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` (doc_id, text, ...) without later copies of repeated line runs; all rows and columns stay, whatever their names.

    A run of any number of lines that has ``min_words`` words and also begins at an earlier line, by (doc_id, line), is deleted; runs
    may overlap. Lines without a word are never deleted and don't part a run. A null text stays null, an empty one empty; a text of
    copies only becomes empty or its blank lines. A very long text is lines like any other: its runs repeat within it too. Of rows that
    tie, being equal, the first stays. Other texts with one doc_id are documents of their own, in the order of a hash, and a row that comes
    again counts once; rows without a doc_id keep their texts. An empty table stays empty.
    """
    row = documents.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), F.xxhash64("text").alias("__h"))
    joined = row.join(_copied_runs(documents, min_words).hint("merge"), ["__id", "__h"], "left").withColumn("__kept", _kept_text())
    return joined.select(*(F.col("__kept").alias("text") if c == "text" else F.col("__row")[c].alias(c) for c in documents.columns))


def line_dedup_report(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256) of each document, by ``remove_repeated_lines``; kept_sha256 is of the remaining text, null as empty.

    Odd rows have the results that ``remove_repeated_lines`` says; n_runs counts unbroken removed lines.
    """
    own = texts(documents).select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.xxhash64("text").alias("__h"))
    joined = own.join(_copied_runs(documents, min_words).hint("merge"), ["__id", "__h"], "left")
    removed = F.aggregate(F.coalesce("__runs", F.array()), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(F.col("__id").alias("doc_id"), F.size(F.split("__text", "\n")).alias("n_lines"), F.coalesce(removed, F.lit(0)).alias("n_removed"), F.coalesce(F.size("__runs"), F.lit(0)).alias("n_runs"), F.sha2(_kept_text(), 256).alias("kept_sha256"))


#: Runs grow line by line while they are repeated: every length, by no suffix order.
LINE_DEDUP_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
worded AS (
  SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM lines),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n FROM worded WHERE words > 0),
runs AS (
  SELECT doc_id, n, length, words, first FROM (
    SELECT doc_id, n, 1 AS length, words, min((doc_id, n)) OVER w AS first, count(*) OVER w AS times FROM seq WINDOW w AS (PARTITION BY body)) WHERE times > 1
  UNION ALL
  SELECT doc_id, n, length, words, first FROM (
    SELECT r.doc_id, r.n, r.length + 1 AS length, r.words + s.words AS words, min((r.doc_id, r.n)) OVER w AS first, count(*) OVER w AS times
    FROM runs r JOIN seq s ON s.doc_id = r.doc_id AND s.n = r.n + r.length WINDOW w AS (PARTITION BY r.first, s.body)) WHERE times > 1),
maximal AS (
  SELECT doc_id, n, max(length) AS length FROM runs WHERE first < (doc_id, n) AND words >= 5 GROUP BY doc_id, n),
gone AS (
  SELECT DISTINCT s.doc_id, s.line FROM maximal e JOIN seq s ON s.doc_id = e.doc_id AND s.n BETWEEN e.n AND e.n + e.length - 1),
marked AS (
  SELECT l.doc_id, l.line, l.body, g.line IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line),
edged AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS begins FROM marked)
SELECT doc_id, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed, CAST(count(*) FILTER (begins) AS INT) AS n_runs,
 sha256(coalesce(string_agg(body, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256
FROM edged GROUP BY doc_id
"""
