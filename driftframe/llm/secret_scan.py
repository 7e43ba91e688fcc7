"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns give base spans of three kinds. Labelled samples of both kinds train first-order character models, and tokens whose
log-likelihood ratio speaks for a random string are further spans. Samples may be given; else they are labelled by rule over the whole
corpus: the values of base spans are random strings, distinct other long tokens of letters, - and _ are ordinary identifiers. A third
of the samples, by a hash of the value, is held out of the training, and ``sample_rates`` counts how many of these the models flag.
DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, texts

#: Fixed patterns of the base spans, in the order of their kinds; least characters of the match, or of its second group.
KINDS = ("assign", "access", "hex", "markov")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]+)()",
    "hex": r"([0-9a-f]{16,})()",  # runs are whole, so that shorter ones can be left out at once
    "markov": r"([A-Za-z0-9+/_=-]{12,})()",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Tokens that may become further spans: characters, and the log-likelihood ratio in all and for each character pair.
TOKEN_LEAST = 20
RATIO_LEAST = 12.0
RATIO_EACH = 0.5
#: Weight of a character's chance anywhere in its chance after another, and the count that every character has.
BACKOFF, SMALL = 20.0, 0.5
IDENTIFIER = "^[A-Za-z_-]+$"
#: Character codes from + to z; pairs of them are the whole model.
FIRST, CODES = 43, 80


def _matches(kind: str) -> F.Column:
    """(kind, nth, characters since the last match, characters, value) of all matches of a kind."""
    pattern = F.lit(PATTERNS[kind])
    text = F.col("text")
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("match"), F.regexp_extract_all(text, pattern, 2 if kind == "assign" else 1).alias("value"))
    rows = F.transform(pairs, lambda p, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), p["value"].alias("value")))
    return F.when(text.rlike(PATTERNS[kind]), F.filter(rows, lambda r: r["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,value:string>>"))


def _pairs(value: str) -> F.Column:
    """Numbers of the neighbouring character pairs of a token."""
    chars = F.transform(F.split(F.col(value), ""), lambda c: F.ascii(c) - FIRST)
    return F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: a * CODES + b)


def _ratios(counts: list[tuple[int, int, int]]) -> list[float]:
    """Log-likelihood ratio of each pair from (pair, count in random strings, count in identifiers).

    Chances of the second character after the first are smoothed with those of the second anywhere.
    """
    logs = []
    for side in (1, 2):
        pairs, firsts, seconds = [0.0] * (CODES * CODES), [0.0] * CODES, [SMALL] * CODES
        for row in counts:
            pairs[row[0]] = row[side]
            firsts[row[0] // CODES] += row[side]
            seconds[row[0] % CODES] += row[side]
        total = sum(seconds)
        logs.append([math.log((x + BACKOFF * seconds[k % CODES] / total) / (firsts[k // CODES] + BACKOFF)) for k, x in enumerate(pairs)])
    return [r - i for r, i in zip(*logs, strict=True)]


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans, and tokens that overlap none, of (doc_id, text, h): (doc_id, h, kind, size, value, start, stop)."""
    found = docs.select("doc_id", "h", F.explode(F.concat(*(_matches(k) for k in KINDS))).alias("m")).select("doc_id", "h", "m.*").distinct()
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("nth")
    stop = F.sum(F.col("gap").cast("long") + F.col("size")).over(before)
    spans = found.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).drop("gap", "nth")
    is_kind = lambda k: F.col("kind") == KINDS.index(k)
    long_enough = F.when(is_kind("assign"), F.length("value") >= LEAST["assign"]).when(is_kind("access"), F.col("size") >= LEAST["access"]).when(is_kind("hex"), F.col("size") >= LEAST["hex"]).otherwise(True)
    # base spans that begin no later reach to `reached`, and those that begin no earlier from `ahead` on: one pass over a text's spans in order
    order = Window.partitionBy("doc_id", "h").orderBy("start")
    own = lambda c: F.when(~is_kind("markov"), F.col(c))
    near = spans.where(long_enough).withColumn("reached", F.max(own("stop")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    near = near.withColumn("ahead", F.min(own("start")).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", "stop") >= F.col("stop"))
    kept = materialize(near.where(~is_kind("markov") | apart).drop("reached", "ahead"), "spans", compact=False)
    return kept.where(~is_kind("markov")), kept.where(is_kind("markov"))


def labelled_samples(documents: DataFrame) -> DataFrame:
    """(value, random) by rule: distinct values of base spans, and distinct long tokens apart from these that are letters, - and _ only."""
    return _samples(*_spans(texts(documents).withColumn("h", F.xxhash64("text"))))


def _samples(base: DataFrame, tokens: DataFrame) -> DataFrame:
    plain = tokens.where(F.col("value").rlike(IDENTIFIER))
    return base.select("value", F.lit(True).alias("random")).unionByName(plain.select("value", F.lit(False).alias("random"))).distinct()


def is_held_out(value: str) -> F.Column:
    return F.crc32(F.encode(F.col(value), "UTF-8")) % 3 == 1


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratio of each character pair, from the samples (value, random) that aren't held out; None without random strings."""
    pairs = samples.where(~is_held_out("value")).select("random", F.explode(_pairs("value")).alias("pair")).where(F.col("pair").between(0, CODES * CODES - 1))
    counts = pairs.groupBy("pair").agg(F.count_if("random").alias("good"), F.count_if(~F.col("random")).alias("bad"))
    rows = [(r["pair"], r["good"], r["bad"]) for r in counts.collect()]  # at most CODES * CODES rows
    return [round(x, 4) for x in _ratios(rows)] if any(good for _, good, _ in rows) else None


def is_random(value: str, model: list[float]) -> F.Column:
    """Whether a long token's log-likelihood ratio, in all and for each pair, speaks for a random string."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    ratio = F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + F.coalesce(F.get(table, pair), F.lit(0.0)))
    return (F.length(value) >= TOKEN_LEAST) & (ratio >= RATIO_LEAST) & (ratio >= RATIO_EACH * (F.length(value) - 1))


def sample_rates(samples: DataFrame) -> DataFrame:
    """(random, n, flagged): held-out samples of TOKEN_LEAST characters or more by label, and how many of them the models call random."""
    model = train(samples)
    flagged = is_random("value", model) if model else F.lit(False)
    held = samples.where(is_held_out("value") & (F.length("value") >= TOKEN_LEAST))
    return held.groupBy("random").agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"))


def secrets(documents: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each document of ``documents`` (doc_id, text, ...).

    samples: labelled strings (value, random) that train the models; by rule from the documents if None. Spans are kind:start:end in code points,
    the end exclusive, by start, then kind, joined by commas; base_sha256 is of those of the three fixed kinds, spans holds all. Model
    spans that overlap a base span are left out; without random strings to learn from there are none. Null and empty texts have no spans; a
    very long text is scanned whole. Rows that tie or repeat a doc_id get a result each, a row without a doc_id too; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    docs = texts(documents).withColumn("h", F.xxhash64("text"))
    base, tokens = _spans(docs)
    model = train(_samples(base, tokens) if samples is None else samples.select("value", "random"))
    every = base.unionByName(tokens.where(is_random("value", model))) if model else base
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    every = every.withColumn("span", F.struct("start", "kind", F.concat_ws(":", name, "start", "stop").alias("said")))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), ",")
    listed = every.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list("span")).alias("all"))
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    listed = listed.select("doc_id", "h", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), said(F.filter("all", lambda x: x["kind"] < 3)).alias("base"), said(F.col("all")).alias("spans"))
    none = lambda c: F.coalesce(F.col(c), F.lit("" if c in ("base", "spans") else 0).cast("string" if c in ("base", "spans") else "long"))
    listed = listed.withColumnRenamed("doc_id", "l_doc").withColumnRenamed("h", "l_h")
    own = F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("h") == F.col("l_h"))
    return docs.select("doc_id", "h").join(listed, own, "left").select("doc_id", *(none(f"n_{k}").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(none("base"), 256).alias("base_sha256"), none("spans").alias("spans"))
