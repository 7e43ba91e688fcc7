"""Nearest neighbours, hard negatives and collocations against brute force, on small tables with every odd case."""

import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from driftframe.llm import collocations, common, count_automata, hard_negatives, queries, vantage_trees, vectors

#: Extra columns have the names that operators use inside.
SCHEMA = "vec_id long, embedding array<float>, label int, shard string, band string, vector string, copy string, rank string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def vector_rows(seed=3, n=700, size=8):
    """Clusters, copies, zeros, nulls and numbers that are none."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] * rng.uniform(0.3, 2) + rng.normal(size=size) * 0.2], int(rng.integers(0, 10))) for i in range(n)]
    same = rows[5][1]
    rows += [(n + i, same, i % 3) for i in range(200)]
    odd = [None, [], [0.0] * size, [float("nan")] + [1.0] * (size - 1), [float("inf")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1)]
    rows += [(2000 + 100 * i, x, 1) for i, x in enumerate(odd)]
    return rows + [(3000, same, None), (3100, None, None), (None, same, 1)]


def usable(row):
    return row[0] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1])


def added(a, b):
    """Component by component; ``sum`` would round otherwise."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def brute_neighbours(rows, n=20):
    own = [(i, np.array(v, dtype=float)) for i, v, _ in filter(usable, rows) if any(v)]
    out = []
    for q, a in own:
        if q % 20 == 0:
            found = sorted((-added(a.tolist(), b.tolist()), i) for i, b in own if i != q)[:n]
            out += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_factor_one_searches_exactly(spark, monkeypatch, small):
    """In one cell, and in many cells with deep trees; scores of equal vectors are equal to the last bit."""
    if small:
        monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 8 * 150)
        monkeypatch.setattr(vectors, "BAND_BYTES", 8 * 8 * 20)
        monkeypatch.setattr(vantage_trees, "LEAF", 8)
    rows = vector_rows()
    got = sorted(map(tuple, vantage_trees.nearest_neighbours(table(spark, rows), factor=1.0).collect()))
    assert got == brute_neighbours(rows)


def test_relaxed_pruning_compares_less_and_finds_nine_in_ten():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 3
    points = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.4
    ids = np.arange(8000)
    tree = vantage_trees.Tree(ids, points)
    asked = ids[::20]
    exact, all_ids, most = tree.search(asked, points[asked], 1.0, 20)
    relaxed, some_ids, fewer = tree.search(asked, points[asked], vantage_trees.FACTOR, 20)
    assert fewer < most < len(asked) * 8000  # both leave out subtrees
    found = sum(len(set(a) & set(b)) for a, b in zip(all_ids.tolist(), some_ids.tolist(), strict=True))
    assert found >= 0.9 * all_ids.size
    assert (relaxed <= exact + 1e-12).all()


def test_few_rows_and_none(spark):
    assert vantage_trees.nearest_neighbours(table(spark, [])).count() == 0
    assert vantage_trees.nearest_neighbours(table(spark, [(0, [1.0, 2.0], 1)])).count() == 0
    rows = [(0, [1.0, 2.0], 1), (1, [2.0, 1.0], 1), (0, [1.0, 3.0], 1)]
    assert [tuple(r) for r in vantage_trees.nearest_neighbours(table(spark, rows)).collect()] == [(0, 1, 1, 4.0)]
    with pytest.raises(ValueError):
        vantage_trees.nearest_neighbours(table(spark, [(0, [1.0], 1), (1, [1.0, 2.0], 1)]))


def test_recall_over_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").collect()]
    want = {r[:1] + r[2:3] for r in brute_neighbours(rows)}
    got = {(r.query_id, r.vec_id) for r in queries.QUERIES["op11_vantage_trees"](spark, sf_dir).collect()}
    assert len(got & want) >= 0.9 * len(want)


def brute_negatives(rows):
    own = []
    for i, v, label in filter(usable, rows):
        if label is not None:
            own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a, label, v in own:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in own)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            found = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_match_all_scores(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "SHARD_BYTES", 8 * 8 * 150)
        monkeypatch.setattr(vectors, "BAND_BYTES", 8 * 8 * 3)
        monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 2)
    rows = vector_rows()
    got = sorted(map(tuple, hard_negatives.hard_negatives(table(spark, rows)).collect()))
    assert got == brute_negatives(rows)
    assert len(got) > 100


def test_no_vectors_no_negatives(spark):
    assert hard_negatives.hard_negatives(table(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(table(spark, [(0, [1.0], 1), (0, [2.0], 3), (1, [1.0], 2)])).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(table(spark, [(0, [1e30], 1)]))


@pytest.mark.parametrize(("size", "most"), [(3, 2), (64, 256), (700, 10**4), (65, 10**7)])
def test_residue_products_are_exact(size, most):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-most, most + 1, (9, size)).astype(float) for _ in range(2))
    a[0], b[0] = most, -most
    bound = most * most * size
    got = hard_negatives.product(a, hard_negatives.residues(b, bound), bound)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
    assert math.prod(hard_negatives.moduli(bound)) > 2 * bound


def test_windows_are_exact_for_large_scores():
    for s in (0, 1, 7, 99, 10**17 + 3, -5):
        least, most = hard_negatives._windows(np.array([s]))
        assert (int(least[0]), int(most[0])) == (-(-30 * s // 100), 90 * s // 100)


DOCS = "doc_id long, text string, lang string, id long, g string, word string, f string, range string, phrase string, times string, k string"


def documents(spark, rows):
    return spark.createDataFrame([(k, *r, k, *"abcdefg") for k, r in enumerate(rows)], DOCS)


def texts(seed=4, n=400):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(25)] + ["été", "Ärger", "of", "the", "x" * 300]
    weights = [1] * 25 + [2, 2, 20, 30, 1]
    fixed = ["New York City", "New York City Hall", "the end of the", "a\x0bb", "one, two; three"]
    out = []
    for k in range(n):
        own = []
        for _ in range(rng.randrange(0, 60)):
            own.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weights)[0])
            own.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]))
        out.append(("".join(own), ["en", "fr", None, "und", ""][k % 5]))
    long = " ".join(rng.choices(words, weights, k=60_000))
    return [*out, (None, "en"), ("", "en"), (" .\n", None), (long, "en"), *[("Same row again and AGAIN", "fr")] * 90]


def brute_collocations(rows, least=30, top=2000):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or ("und" if lang is None else lang)] += len(w)
            for n in (1, 2, 3, 4):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + n])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in often.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                key = (lang, p[i : i + n])
                inside[key] = max(inside.get(key, 0), a)
    by_lang = {}
    for (lang, p), a in often.items():
        if 100 * inside.get((lang, p), 0) >= 80 * a:
            continue
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, own in by_lang.items() for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("small", [False, True])
def test_collocations_match_plain_counts(spark, monkeypatch, small):
    """In one group and range, and in many, with first words that are divided and parts that are looked up in several tasks."""
    if small:
        monkeypatch.setattr(collocations, "RANGE_TOKENS", 3_000)
        monkeypatch.setattr(collocations, "PARTS_AT_ONCE", 200)
        monkeypatch.setattr(collocations, "HOT_LEAST", 1)
        monkeypatch.setattr(collocations, "HOT_KEYS", 50)
        monkeypatch.setattr(collocations, "group_count", lambda total, each=20_000: common.group_count(total, each))
    rows = texts()
    got = sorted(map(tuple, collocations.collocations(documents(spark, rows)).collect()))
    assert got == brute_collocations(rows)
    assert len({r[0] for r in got}) == 4


def test_only_the_first_phrases_of_a_language(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP", 7)
    rows = texts()
    got = sorted(map(tuple, collocations.collocations(documents(spark, rows)).collect()))
    assert got == brute_collocations(rows, top=7)


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(None, None), ("a b c", "en")])).count() == 0


def plain(levels, ids):
    """All sequences of a tree with their counts."""
    out, paths = {}, [(int(p),) for p in levels.parents[0]]
    paths = [(*p, int(w)) for p, w in zip(paths, levels.words[0], strict=True)]
    for k in range(3):
        if k:
            paths = [(*paths[p], int(w)) for p, w in zip(levels.parents[k], levels.words[k], strict=True)]
        out |= {tuple(int(ids[x]) for x in p): int(c) for p, c in zip(paths, levels.counts[k], strict=True)}
    return out


def test_automata_hold_all_counts_and_share_states():
    rng = np.random.default_rng(2)
    both = []
    ids = np.sort(rng.choice(10**12, 40, replace=False))
    want = Counter()
    for _ in range(3):
        token = rng.integers(-1, 40, 3000) % rng.integers(2, 41)
        linked, weight = rng.random(3000) < 0.8, rng.integers(1, 4, 3000)
        tree = count_automata.Levels.of_tokens(token, linked, weight)
        for i in range(3000):
            for n in (2, 3, 4):
                if i + n <= 3000 and (token[i : i + n] >= 0).all() and linked[i + 1 : i + n].all():
                    want[tuple(ids[token[i : i + n]].tolist())] += int(weight[i])
        everything = [np.ones(len(w), dtype=bool) for w in tree.words]
        both.append(tree.part(everything[0], everything[0], everything[1]).automaton(ids))
        back, own = count_automata.Levels.of_automaton(both[-1])
        assert plain(back, own) == plain(tree, ids)
        arrays = count_automata.decode(both[-1])
        assert len(arrays[5]) <= len(tree.words[0]) and len(arrays[9]) < len(tree.words[1])  # states are shared
    united, own = count_automata.union(both)
    assert plain(united, own) == dict(want)


@pytest.mark.parametrize("at_once", [1, 300, 1 << 18])
def test_automata_of_many_ranges_hold_what_falls_into_each(monkeypatch, at_once):
    monkeypatch.setattr(count_automata, "SEQUENCES_AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    ids = np.sort(rng.choice(10**12, 30, replace=False))
    token = rng.integers(-1, 30, 2000)
    tree = count_automata.Levels.of_tokens(token, rng.random(2000) < 0.8, rng.integers(1, 4, 2000))
    pair, triple = rng.integers(0, 40, len(tree.words[0])) * 3, rng.integers(0, 50, len(tree.words[1])) * 3
    triple = np.where(rng.random(len(triple)) < 0.5, pair[tree.parents[1]], triple)  # others lie in another range than their beginning
    got = list(tree.automata(pair, triple, ids))
    assert [r for r, _ in got] == sorted({*pair.tolist(), *triple.tolist()})
    for r, data in got:
        own, three = pair == r, triple == r
        two = own | np.isin(np.arange(len(pair)), tree.parents[1][three])
        assert plain(*count_automata.Levels.of_automaton(data)) == plain(tree.part(two, own, three), ids)
        assert data == tree.part(two, own, three).automaton(ids)
    united, used = count_automata.union([data for _, data in got])
    assert plain(united, used) == plain(tree, ids)
    assert list(tree.part(np.zeros(len(pair), bool), np.zeros(len(pair), bool), np.zeros(len(triple), bool)).automata(pair[:0], triple[:0], ids)) == []


def test_many_ranges_are_little_more_work_than_few():
    """A group's work must not grow with the number of ranges, which grows with the input."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(600)]
    texts = pa.table({"lang": ["en"] * 60, "text": [" ".join(rng.choice(words, 2000)) for _ in range(60)], "times": [1] * 60})
    known = pa.table({"lang": ["en"] * 600, "word": words, "id": range(600), "splits": [1] * 600})

    def seconds(ranges):
        took = []
        for _ in range(2):
            began = time.process_time()
            collocations._automata(ranges)(texts, known)
            took.append(time.process_time() - began)
        return min(took)

    seconds(1)
    assert seconds(1000) < 4 * seconds(5)


def test_states_are_one_only_if_their_arcs_are_equal(monkeypatch):
    """Also where all signatures are equal."""
    monkeypatch.setattr(count_automata, "_mix", lambda x: np.zeros(len(x), dtype=np.uint64))
    state, length, arcs = count_automata.share(np.array([2, 1, 2, 0, 2]), [np.array([1, 2, 1, 1, 2, 1, 3])])
    assert state[0] == state[2] and len({*state.tolist()}) == 4
    start = np.cumsum(length) - length
    own = [arcs[0][start[s] : start[s] + length[s]].tolist() for s in state]
    assert own == [[1, 2], [1], [1, 2], [], [1, 3]]


@pytest.mark.parametrize("name", ["op12_residue_negatives", "op13_count_automata"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
