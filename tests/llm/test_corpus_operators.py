"""The corpus operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from driftframe.llm import (
    common,
    decontamination,
    kernels,
    line_dedup,
    lm_scoring,
    minhash_dedup,
    packing,
    quality_classifier,
    quality_rules,
    queries,
    run_length_index,
    secret_scan,
    token_counts,
)

from pyspark.sql import functions as F

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n int, line string, rep int, g int, w string, component string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été Ärger".split()


def make(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", None, "x", 1, "y", 2, 3, "z", "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(30, 160)) for _ in range(12)]
    texts = [None, "", "   \n\t ", "one", "One", "two words", "a b c d", "A B\tC\nd", "a b c d e", base[0], base[0], base[0].upper(), base[0].replace(" ", "\n", 7)]
    for b in base:
        own = b.split()
        for share in (0.02, 0.04, 0.06, 0.1, 0.3):
            texts.append(" ".join(rng.choice(WORDS) if rng.random() < share else w for w in own))
        texts.append(f"{sentence(rng, 30)} {' '.join(own[:25])} {sentence(rng, 20)}")
    texts.append(" ".join(sentence(rng, 400) for _ in range(40)))  # a very long one
    texts.append("x" * 3000)
    texts.append("ab " * 900)
    rng.shuffle(texts)
    return list(enumerate(texts, start=3))


def words(text):
    return WHITE.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates_match_all_pairs(spark):
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(make(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("hot", [1000, 5])
def test_near_duplicates_of_a_dense_group(spark, monkeypatch, hot):
    """Copies around the similarity, where pivots miss links, exact copies, and a passage that all documents hold; with hot keys and without."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    rng = random.Random(5)
    base, passage = sentence(rng, 120).split(), sentence(rng, 40)
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(i, f"{passage} {sentence(rng, 30)}") for i in range(200, 300)]
    rows += [(i, rows[3][1]) for i in range(400, 440)]
    got = {r[0]: tuple(r)[1:] for r in minhash_dedup.near_duplicates(make(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_signatures_are_circulant():
    """Coordinate k is the least second permutation of the scattered shingles, shifted by k."""
    values = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    got = minhash_dedup.signatures(values, np.array([0, 200]), 8)
    spare = np.empty(500, np.uint32)
    scattered = minhash_dedup._permute((values >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35, spare)
    for k in range(8):
        moved = minhash_dedup._permute(((scattered.astype(np.int64) - k - 1) % 2**32).astype(np.uint32), 0x7FEB352D, 0x846CA68B, spare)
        assert list(got[:, k]) == [moved[:200].min(), moved[200:].min()]


def test_components_of_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    stars = [(300, 300 + i) for i in range(1, 60)] + [(499, 400 + i) for i in range(60)]
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)] + stars, "a long, b long")
    ids = [*range(41), 100, 101, 200, *range(300, 360), *range(400, 460), 499]
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    got = dict(map(tuple, minhash_dedup.components(links, nodes).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, **{i: i // 100 * 100 for i in ids if i >= 300}}


def brute_repeats(rows, width=50):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone, own = bytearray(len(raw)), []
        for p in range(len(raw) - width + 1):
            x = raw[p : p + width]
            if x in seen:
                gone[p : p + width] = b"\1" * width
            own.append(x)
        seen.update(own)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for q in range(len(raw)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("groups", [1, 5])
def test_repeats_match_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(run_length_index, "group_count", lambda b: groups)
    rows = [*corpus(), (900, "\x00" * 70 + "q" * 49), (901, "z" + "\x00" * 60), (902, "y" * 60 + "é" * 40), (903, "é" * 45)]
    got = {r[0]: tuple(r)[1:] for r in run_length_index.remove_repeats(make(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_long_texts_come_in_slices(spark):
    rows = corpus(2)
    got = {r[0]: tuple(r)[1:] for r in run_length_index.remove_repeats(make(spark, rows), run_length_index.Sizes(slice=700, index=2000)).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("groups", [1, 4])
def test_hot_anchors_are_split(spark, monkeypatch, groups):
    """A passage in all documents, with other text around it each time: its anchors have a stretch for each document."""
    monkeypatch.setattr(run_length_index, "group_count", lambda b: groups)
    rng = random.Random(12)
    passage, edge = sentence(rng, 12), sentence(rng, 3)
    rows = [(i, f"{sentence(rng, 9)} {passage} {sentence(rng, 9)} {edge}{rng.choice('ab')}{rng.choice('cd')}{'ab ' * 40}{sentence(rng, 2)}") for i in range(120)]
    rows += [(200 + i, t) for i, t in rows[:30]] + [(400 + i, t) for i, t in corpus(5)[:20]]
    got = {r[0]: tuple(r)[1:] for r in run_length_index.remove_repeats(make(spark, rows), run_length_index.Sizes(hot_texts=20, hot_kinds=0)).collect()}
    assert got == brute_repeats(rows)
    data = np.frombuffer(rows[0][1].encode(), dtype=np.uint8)
    found = run_length_index.stretches(data, np.array([0, len(data)]))
    split = run_length_index._with_split(data, np.array([0, len(data)]), np.unique(found[2]), found)
    assert len(split[0]) > len(found[0]) and split[1].max() == 2 and split[1].sum() == found[1].sum() == len(data) - 49


@pytest.mark.parametrize("groups", [1, 3])
def test_an_anchor_of_many_stretches_is_hot_in_any_number_of_groups(groups):
    """One passage with other text around it in each document: as many stretches as documents, known of one group as of several."""
    import pyarrow as pa

    rng, sizes = random.Random(3), run_length_index.Sizes(hot_texts=64)
    rows = []
    for g in range(groups):
        texts = [f"{rng.randrange(10**20):020d}the quick brown fox jumps over it{rng.randrange(10**20):020d}{rng.randrange(10**20):020d}" for _ in range(300 // groups)]
        ids = list(range(1000 * g, 1000 * g + len(texts)))
        rows.append(run_length_index._anchor_rows(1, sizes)(pa.table({"doc_id": ids, "text": texts, "g": [g] * len(ids)})))
    found = run_length_index._repeated(sizes)(pa.concat_tables(rows))
    same = run_length_index._repeated(run_length_index.Sizes(hot_texts=512))(pa.concat_tables(rows))
    assert all(len(x) > 0 for x in found.column("hot").to_pylist())
    assert all(len(x) == 0 for x in same.column("hot").to_pylist())


def test_cuts_are_the_buckets_that_have_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    for buckets in (1, 7, 10**6):
        got = run_length_index.cuts(keys, buckets)
        assert [(b, keys[s].tolist()) for b, s in got] == [(b, [k for k in keys.tolist() if ((k >> 32) * buckets) >> 32 == b]) for b in sorted({((k >> 32) * buckets) >> 32 for k in keys.tolist()})]
    assert run_length_index.cuts(keys[:0], 5) == []


def test_matching_statistics_are_those_of_brute_force():
    """Of strings that the index doesn't hold, with letters that it lacks."""
    rng = np.random.default_rng(3)
    for letters, longest in ((2, 90), (3, 60), (40, 70)):
        size = rng.integers(1, longest, 40)
        text = rng.integers(65, 65 + letters, size.sum()).astype(np.uint8)
        held = [bytes(x) for x in np.split(text, np.cumsum(size)[:-1])]
        asked = [bytes(rng.integers(65, 66 + letters, n).astype(np.uint8)) for n in rng.integers(1, 50, 30)] + held[:5] + [held[7][3:] + held[8][:20] + b"zz" + held[9], b"z"]
        index = run_length_index.RunLengthIndex(text, size, np.arange(40), 9)
        flat = np.frombuffer(b"".join(asked), dtype=np.uint8)
        length, place = index.matching_statistics(flat, np.array([len(x) for x in asked]))
        whole = b"\n".join(held) + b"\n"
        at = 0
        for x in asked:
            for k in range(len(x)):
                want = max((n for n in range(len(x) - k + 1) if any(x[k : k + n] in h for h in held)), default=0)
                assert length[at] == want
                assert whole[place[at] : place[at] + want] == x[k : k + want]
                if want >= 9:
                    assert index.least[index.interval[place[at]]] == min(d for d, h in enumerate(held) if x[k : k + 9] in h)
                at += 1
        assert index.runs < index.n


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*corpus(), (700, "It's Ünïcode, isn't it?! 12 3rd x…,y don't'll A.b.c 'S é"), (701, "naïve-café…！ ﬁ")]
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack_sequences(make(spark, rows)).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, want in ids.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert (at == 2048 or at & (at - 1) == 0) and at <= 2048 and len(own) <= packing.MAX_SEGMENTS  # no padding


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_packing_holds_all_limits(share):
    """Loss of prompts and answers in turn, below the limit on tokens; little padding where the limits let it."""
    rng = random.Random(0)
    docs = []
    for i in range(500):
        n = rng.randrange(1, 900 if i % 50 == 0 else 200)
        bears = np.repeat(np.array([rng.random() < share for _ in range(n // 10 + 1)]), 10)[:n]
        bears[0] = False
        docs.append((i, np.arange(n, dtype="<u4"), bears))
    seq = defaultdict(list)
    for doc, start, length, _, _, sequence, _ in packing.sequences(iter(docs), 0, 256, 6, 150):
        seq[sequence].append((length, int(docs[doc][2][start : start + length].sum())))
    assert all(sum(a for a, _ in s) <= 256 and len(s) <= 6 and sum(b for _, b in s) <= 150 for s in seq.values())
    tokens = sum(len(x) for _, x, _ in docs)
    assert sum(a for s in seq.values() for a, _ in s) == tokens
    assert max(sum(b for _, b in s) for s in seq.values()) == (0 if not share else 150)
    assert len(seq) <= 1.06 * max(tokens / 256, sum(int(b.sum()) for *_, b in docs) / 150) + 9


def test_packing_reads_loss_spans(spark):
    """Ids bear loss where their word begins in a span of bytes; the limit binds then."""
    text = "é " + " ".join(["question"] * 30) + " " + " ".join(["answer"] * 30)
    at = text.encode().index(b"answer")
    spans = "array<struct<start:int,stop:int>>"
    docs = spark.createDataFrame([(i, text, [(at, 10**6)] if i % 3 else None if i else []) for i in range(40)], f"doc_id long, text string, loss {spans}")
    own = packing.WordTokens(packing.public_tokenizers.path("word_bpe_49k.json"))
    ids, _, places = own(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]))
    bears = {0: packing.bearing(places, []), 1: packing.bearing(places, [{"start": at, "stop": 10**6}]), 3: packing.bearing(places, None)}
    assert bears[0].sum() == 0 and bears[3].sum() == len(ids) and bears[1].sum() == sum(p >= at for p in places) + 1
    seq = defaultdict(int)
    for r in packing.pack_sequences(docs.coalesce(1), length=256, max_loss=90, loss="loss").collect():
        mask = bears[0 if r.doc_id == 0 else 3 if r.doc_id % 3 == 0 else 1]
        seq[r.sequence_id] += mask[r.start : r.start + r.length].sum()
    assert max(seq.values()) == 90
    with pytest.raises(ValueError):
        packing.pack_sequences(docs, max_loss=0)


def lined(seed=4):
    rng = random.Random(seed)
    pool = [sentence(rng, rng.choice((1, 2, 3, 6, 9))) for _ in range(40)] + ["", " "]
    block = [rng.choice(pool) for _ in range(12)]
    texts = [None, "", "\n\n", "a\nb\nc\nd\ne", "a\nb\nc\nd\ne", "\n".join(block), "\n".join(["x", *block, "y"]), "\n".join(block[3:9])]
    texts += ["\n".join(rng.choice(pool) if rng.random() < 0.4 else sentence(rng, 4) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    return list(enumerate(texts))


def brute_maximal(rows, least=5):
    """Runs of every length that begin earlier too and have the words."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        used = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for s in range(len(used)):
            for n in range(1, len(used) - s + 1):
                run = tuple(lines[k] for k in used[s : s + n])
                if run in seen and sum(len(words(x)) for x in run) >= least:
                    gone.update(used[s : s + n])
                seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def in_blocks():
    """Passages whose words suffice only at lengths that are no power of two, among other lines."""
    blocks = ["a b\nc\nd e", *("\n".join("klmnopq"[:n]) for n in (5, 6, 7)), "r\ns t u v w\nx", "aa bb\n \ncc\ndd ee"]
    return [(1000 + 100 * k + j, f"{j} own {k}\n{x}\n{j} more {k}") for k, x in enumerate(blocks) for j in range(2)]


@pytest.mark.parametrize(("least", "hot"), [(5, 1000), (1, 2), (9, 4)])
def test_line_dedup_matches_brute_force(spark, monkeypatch, least, hot):
    """With hot keys, that are sent to executors, and without; names of columns that the operator uses inside."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    rows = lined(least) + in_blocks() + [(5000, "\n".join(f"line {k % 90} of many" for k in range(400)))]
    docs = make(spark, rows).withColumnsRenamed({"h": "__runs", "n": "__id", "line": "__kept"})
    out = line_dedup.remove_repeated_lines(docs, least)
    assert out.columns == docs.columns
    want = brute_maximal(rows, least)
    assert {r.doc_id: r.text for r in out.collect()} == {i: None if t is None else want[i] for i, t in rows}
    report = {r.doc_id: r.kept_sha256 for r in line_dedup.line_dedup_report(docs, least).collect()}
    assert report == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}
    if least == 5:
        assert want[1001] == "1 own 0\n1 more 0" and want[1501] == "1 own 5\n \n1 more 5"


def test_suffix_array_and_its_prefixes(spark):
    """The order is that of the rank sequences, LCPs those of neighbours, over more than one range."""
    rows = lined(3)
    prefixes = line_dedup._prefixes(line_dedup._line_positions(make(spark, rows)), 6)
    array = line_dedup._suffix_array(prefixes, 6).orderBy("rank").collect()
    got = [list(r.prefix) for r in array]
    assert got == sorted(got) and len({tuple(x) for x in got}) == len(got) and len({r.rank >> 33 for r in array}) > 1
    for before, row in zip(array, array[1:], strict=False):
        same = [a == b for a, b in zip(before.prefix, row.prefix, strict=False)] + [False]
        assert row.lcp == same.index(False)
    sizes = {len(x) for x in got}
    assert max(sizes) == 6 and min(sizes) == 1


def test_line_dedup_sql(spark):
    rows = lined(6) + in_blocks()
    docs = make(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted(con.sql(line_dedup.LINE_DEDUP_SQL).fetchall())
    assert sorted(map(tuple, line_dedup.line_dedup_report(docs).collect())) == want


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(1, sentence(rng, 14)), (2, sentence(rng, 40)), (3, "Two words"), (4, "single"), (5, None), (6, ""), (7, "k k k k k k k"), (8, sentence(rng, 5)), (1, None)]
    texts = [None, "", "nothing here at all really", "the two WORDS are here", "k k k k k k k k"]
    for _, t in items[:2]:
        own = t.split()
        texts.append(f"{sentence(rng, 900)} {t.upper()} {sentence(rng, 300)}")
        texts.append(f"{sentence(rng, 50)} {' '.join(own[: len(own) - 2])}")
        texts.append(f"{sentence(rng, 50)} {' '.join(own[: len(own) // 2])}")
    rows = list(enumerate(texts))
    bench = spark.createDataFrame([(i, t, "d", 4) for i, t in items], "item_id long, text string, doc_id string, width int")
    got = sorted(map(tuple, decontamination.contaminated(make(spark, rows), bench).collect()))
    want = []
    by = defaultdict(set)
    for i, t in items:
        w = words((t or "").lower())
        k = min(5, len(w))
        by[i] |= {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if w else set()
    for d, t in rows:
        w = words((t or "").lower())
        for i, own in by.items():
            held = {s for s in own if any(tuple(w[a : a + len(s)]) == s for a in range(len(w)))}
            if own and 100 * len(held) >= 75 * len(own):
                want.append((d, i, len(own), len(held)))
    assert got == sorted(want)


def test_quality_rules_base_counts(spark):
    rows = [*corpus(), (800, "a b c a b c x\n\nred red\nred red\n red red\nred red"), (801, "# * $ % & | < > é"), (802, "w " * 60)]
    for r in quality_rules.quality_rules(make(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        w = words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        marked = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 3)} if len(w) < 3000 else None
        lines, dups = set(), 0
        for line in text.split("\n"):
            dups += bool(words(line)) and line in lines
            lines.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups)
        if marked is not None:
            assert r.n_repeat_words == len(marked)
            assert r.base_failed == (len(w) < 50 or 100 * len(marked) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rules_count_first_lines_of_all_documents():
    texts = ["x", "a\nb\na", "", "a\na", "\n", "\na\n\na", "b\n", "a \na\na "]
    for _, _, data, offsets in quality_rules.K.pieces(*quality_rules.K.buffers(pa.array(texts))):
        assert quality_rules.Base(data, offsets).lines.tolist() == [0, 1, 0, 1, 0, 1, 0, 1]


def test_quality_rules_tell_junk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.2 * len(bad)


def brute_verdicts(rows):
    """Kept, distances and whether judged by them of (doc_id, text, lang), with plain counts of everything."""
    kinds = [("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\n\x0b\x0c\r", 3), (".,;:!?'\"()-", 4), ("#*$%&|<>", 5)]
    kind = lambda c: next((k for chars, k in kinds if c in chars), 6 if ord(c) < 128 else 7)

    def base(text):
        w = words(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        marked = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 3)}
        return len(w) < 50 or 100 * len(marked) > 50 * len(w)

    def shares(counts, keys):
        total = max(1, sum(counts.values()))
        return [counts[k] / total for k in keys]

    def distance(p, q):
        term = lambda a, m: a * np.log2(a / m) if a else 0
        return np.sqrt(min(1, max(0, sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, q, strict=True)) / 2)))

    languages = defaultdict(list)
    for _, text, lang in rows:
        if not base(text or ""):
            languages[lang or ""].append(text)
    refs = []
    for own in languages.values():
        counted = Counter(x for t in own for x in words(t))
        if len(own) >= quality_rules.MIN_REFERENCE_DOCUMENTS and sum(counted.values()) >= quality_rules.MIN_REFERENCE_WORDS:
            common = [w for w, _ in sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]]
            refs.append((shares(Counter(kind(c) for t in own for c in t), range(8)), common, [counted[w] / sum(counted.values()) for w in common]))
    out = {}
    known = {lang for lang, own in languages.items() if len(own) >= quality_rules.MIN_REFERENCE_DOCUMENTS and sum(len(words(t)) for t in own) >= quality_rules.MIN_REFERENCE_WORDS}
    for i, text, lang in rows:
        w, best = words(text), (np.inf, 1.0, 1.0)
        limits = [float(x[0]) for x in quality_rules.limits(np.array([len(w)]))]
        for chars, common, freq in refs:
            dc = distance(shares(Counter(kind(c) for c in text or ""), range(8)), chars)
            own = [w.count(x) / max(1, len(w)) for x in common]
            dw = distance([*own, max(0, 1 - sum(own))], [*freq, max(0, 1 - sum(freq))])
            best = min(best, (max(dc / limits[0], dw / limits[1]), dc, dw), key=lambda x: x[0])
        near = (best[1] <= limits[0] or len(text or "") < quality_rules.MIN_CHARS) and (best[2] <= limits[1] or len(w) < quality_rules.MIN_COUNTED_WORDS)
        judged = (lang or "") in known
        out[i] = (not base(text or "") and (near or not judged), best[1], best[2], judged)
    return out


def test_quality_verdicts_match_plain_counts(spark):
    rng, rows = random.Random(16), []
    pools = {"aa": WORDS[:14], "bb": WORDS[14:], None: ["Ä1", "b#", "c.", "ddd", "e-e", "fff", "é"]}
    for lang, pool in pools.items():
        for _ in range(14):
            rows.append((len(rows), " ".join(rng.choice(pool) + rng.choice(("", "", ",", str(rng.randrange(9)))) for _ in range(rng.randrange(60, 260))), lang))
    mixed = sum(pools.values(), [])
    rows += [(len(rows) + k, " ".join(f"{rng.choice(mixed)}{rng.randrange(10**k)}" for _ in range(120)), "aa") for k in range(7)] + [(900, None, "aa"), (901, "", None)]
    rows += [(910 + k, " ".join(rng.choice(["xyz", "zzz", "9", "#!"]) + str(rng.randrange(10**3)) for _ in range(300)), "small") for k in range(9)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = brute_verdicts(rows)
    assert {r.kept for r in got.values()} == {True, False}
    assert all(r.kept and not r.judged for i, r in got.items() if i >= 910)
    for i, (kept, by_char, by_word, judged) in want.items():
        assert got[i].kept == kept and got[i].judged == judged and np.allclose((got[i].char_distance, got[i].word_distance), (by_char, by_word))


@pytest.mark.parametrize("at_once", [8192, 20])
def test_quality_rules_know_every_language(spark, monkeypatch, at_once):
    """More than 64 languages of other words each, the last ones smaller; junk in one of them, and in a lang of its own, which has no reference."""
    monkeypatch.setattr(quality_rules, "STEP_LANGUAGES", at_once)
    rng, rows = random.Random(6), []
    for k in range(70):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(60)]
        rows += [(len(rows) + d, " ".join(rng.choice(own) for _ in range(250 if k < 64 else 220)), f"l{k:02d}") for d in range(12)]
    junk = "".join(f"{rng.randrange(10**9)} " for _ in range(4000))
    rows += [(5000, junk[:900], "l05"), (5001, junk, "junk")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[5000].base_failed and not got[5000].kept
    assert got[5001].kept and not got[5001].judged
    assert all(r.kept and r.judged for i, r in got.items() if i < 5000)


def brute_spans(text):
    out = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(2)
    rows = corpus()
    token = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    for k in range(60):
        rows.append((1000 + k, f"é𝄞 {sentence(rng, 5)} password = \"{token(24)}\" and AKIA{token(16).upper()}; token=short Token:'abc' key {'_'.join(rng.choice(WORDS[:20]) for _ in range(9))} {rng.randrange(16**20):020x} secret=api_key: {token(20)}"))
    rows += [(1500 + k, " ".join("".join(rng.choice(WORDS[:20]) for _ in range(4)) for _ in range(60))) for k in range(40)]
    rows += [(2000, f"plain {token(40)} word"), (2001, "token=" + "a" * 11), (2002, "AKIA" * 9), (2003, "deadbeef" * 3)]
    got = {r.doc_id: r for r in secret_scan.secrets(make(spark, rows)).collect()}
    for i, text in rows:
        want = brute_spans(text or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert "markov:6:46" in got[2000].spans
    assert got[min(i for i, t in rows if t and len(t) > 20000)].spans == ""


def test_secret_models_on_held_out_samples(spark):
    samples = secret_scan.labelled_samples(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rates = {r.random: (r.n, r.flagged) for r in secret_scan.sample_rates(samples).collect()}
    print(rates)
    assert rates[True][0] >= 30 and rates[True][1] > 0.8 * rates[True][0]
    assert False not in rates or rates[False][1] <= 0.02 * rates[False][0]


def test_secrets_from_given_samples(spark):
    """Overlaps with base spans, on both sides; models from samples that the user labelled."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["data", "table", "_", "file", "user", "name"]) for _ in range(6))
    token = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    samples = spark.createDataFrame([(f"{word()}x", False) for _ in range(300)] + [(token(), True) for _ in range(300)], "value string, random boolean")
    secret = token()
    rows = [(1, f"a {secret} b"), (2, f"token={secret}"), (3, f"{'0123456789abcdef' * 2}{secret}"), (4, word() + word()), (5, None)]
    got = {r.doc_id: r.spans for r in secret_scan.secrets(make(spark, rows), samples).collect()}
    assert got[1] == "markov:2:32" and got[2] == "assign:0:36" and got[4] == got[5] == ""
    assert got[3].startswith("hex:0:3") and "markov" not in got[3]


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert {r.held_out for r in rows} == {True} and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    right = [(r.predicted == r.quality) for r in rows]
    assert sum(right) > 0.95 * len(right)
    odd = make(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "y" * 100_000)])
    model = quality_classifier.fit(docs, quality_classifier.training_labels(labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in quality_classifier.score(odd, model).collect())
    none = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(odd, none).collect()} == {0.5}


def test_quality_classifier_learns_from_few(spark):
    """One document of each class, one of them very long with its kind at the end; scores of others like them."""
    rng = random.Random(1)
    kinds = [[f"{rng.randrange(10**9)}" for _ in range(300)], [rng.choice(WORDS) for _ in range(300)]]
    text = lambda q, n: " ".join(rng.choice(kinds[q]) for _ in range(n))
    rows = [(0, text(0, 3000)), (1, text(1, 3000)), *((i, text(i % 2, 200)) for i in range(2, 30)), (30, None), (0, text(0, 10))]
    model = quality_classifier.fit(make(spark, rows), spark.createDataFrame([(0, 0), (1, 1), (30, 1), (99, 0)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality_classifier.score(make(spark, rows), model).where("doc_id between 2 and 29").collect()}
    assert all((x >= 0.5) == (i % 2 == 1) for i, x in got.items()) and len(got) == 28
    assert quality_classifier._blocks(b"x" * 2000, 1) == [b"x" * 1024, b"x" * 976]
    long = b"".join(bytes([k]) * 1024 for k in range(100))
    assert len(quality_classifier._blocks(long, 5)) == 8 and max(b[0] for b in quality_classifier._blocks(long, 5)) > 50


def brute_cross_entropy(rows, wanted):
    tokens = [(i, words(lower(t))) for i, t in rows]
    everything, target = Counter(), Counter()
    for i, w in tokens:
        for model in (everything, target) if i in wanted else (everything,):
            model.update(w)
            model.update(zip(w, w[1:], strict=False))
    size = lambda m: sum(n for k, n in m.items() if isinstance(k, str))
    vocabulary, sizes = sum(isinstance(k, str) for k in everything), (size(target), size(everything))
    out = {}
    for i, w in tokens:
        means, own = [], Counter(w) + Counter(zip(w, w[1:], strict=False))
        for model, total, counted in ((target, sizes[0], i in wanted), (everything, sizes[1], True)):
            scale = sizes[0] / max(1, total)
            left = lambda k, model=model, counted=counted, scale=scale: scale * (model[k] - own[k] * counted)
            loss = 0
            for k, x in enumerate(w):
                p = (left(x) + 0.5) / (scale * (total - len(w) * counted) + 0.5 * vocabulary)
                if k:
                    p = (left((w[k - 1], x)) + 5 * p) / (left(w[k - 1]) + 5)
                loss -= np.log(p)
            means.append(loss / max(1, len(w)))
        out[i] = (len(w), means[0], means[1], means[1] - means[0])
    return out


@pytest.mark.parametrize("groups", [1, 5])
def test_cross_entropy_counts_are_exact(spark, monkeypatch, groups):
    monkeypatch.setattr(lm_scoring, "group_count", lambda b: groups)
    rows = corpus(4)
    assert max(len(t or "") for _, t in rows) > 50_000
    docs = make(spark, rows)
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) AS quality")
    got = {r[0]: tuple(r)[1:] for r in lm_scoring.cross_entropy_difference(docs, labels).collect()}
    want = brute_cross_entropy(rows, {i for i, _ in rows if i % 4 == 0})
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_cross_entropy_without_a_target(spark):
    docs = make(spark, [(1, "a b a"), (2, None), (2, "a b a")])
    got = lm_scoring.scores(docs, docs.where("false")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in got) == [(1, 3, 0.0), (2, 0, 0.0), (2, 3, 0.0)]


def test_cross_entropy_does_not_score_membership(spark):
    """Labelled good documents score alike whether they are in the target or not, and above bad ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = lm_scoring.scores(docs, labels.where("quality = 1").where(~held_out)).where("n_tokens > 0").join(labels, "doc_id").select("quality", held_out.alias("out"), "score").collect()
    median = lambda q, out: float(np.median([r.score for r in rows if r.quality == q and r.out == out]))
    assert abs(median(1, True) - median(1, False)) < 0.2
    assert median(1, True) > median(0, True) + 1
    good, bad = (np.array([r.score for r in rows if r.quality == q and r.out]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.75


def test_separator_scan(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SCAN_BLOCKS", 3)
    rng = np.random.default_rng(1)
    rows, want = [], []
    for file in range(3):
        ids = rng.integers(0, 7, 400).astype("<u2")
        if file == 1:
            ids[50:300] = 1  # a document over many blocks
        if file == 2:
            ids[-1] = 3
        stops = np.flatnonzero(ids == 3)
        start = 0
        for k, e in enumerate(stops):
            want.append((file, k, start, e - start))
            start = e + 1
        if start < len(ids):
            want.append((file, len(stops), start, len(ids) - start))
        rows += [(file, b, bytearray(ids[b * 16 : b * 16 + 16].tobytes())) for b in range(25)]
    blocks = spark.createDataFrame(rows, "file long, block long, data binary")
    assert sorted(map(tuple, token_counts.separator_scan(blocks, 3).collect())) == sorted(want)


def test_token_counts(spark, monkeypatch):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 1000)
    rows = corpus()
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(make(spark, rows)).collect()}
    assert got == {i: len(own.encode_ordinary(t or "")) for i, t in rows}


def test_rows_without_an_id_and_repeated_rows(spark, sf_dir):
    """No crash, and a defined result: see the docstrings."""
    rng = random.Random(9)
    t = sentence(rng, 80)
    rows = [(None, t), (None, None), (1, t), (1, t), (2, t), (2, "other " + sentence(rng, 70)), (3, f"{t} token=abcdefghijkl")]
    docs = make(spark, rows)
    every = list(map(tuple, minhash_dedup.near_duplicates(docs).collect()))
    assert sorted(r for r in every if r[0] is None) == [(None, 0, None, True), (None, 76, None, True)]
    near = sorted(r for r in every if r[0] is not None)
    assert [r[0] for r in near] == [1, 1, 2, 2, 3] and sorted(r[2] for r in near) == [1, 1, 1, 1, 2]
    every = list(map(tuple, run_length_index.remove_repeats(docs).collect()))
    repeats, lost = sorted(r for r in every if r[0] is not None), [r for r in every if r[0] is None]
    assert [(r[0], r[2] > 0) for r in repeats] == [(1, False), (1, False), (2, False), (2, True), (3, True)]
    assert sorted(r[1] for r in lost) == [0, len(t.encode())] and {r[2:4] for r in lost} == {(0, 0)} and hashlib.sha256(t.encode()).hexdigest() in {r[4] for r in lost}
    lines = line_dedup.remove_repeated_lines(docs).collect()
    assert len(lines) == len(rows) and {r.text for r in lines if r.doc_id is None} == {t, None}
    found = secret_scan.secrets(docs).collect()
    assert len(found) == len(rows) and sum(r.n_assign for r in found) == 1
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (1, 0)], "doc_id long, quality int")
    for result in (quality_classifier.quality_scores(docs, labels), packing.pack_sequences(docs), lm_scoring.cross_entropy_difference(docs, labels), token_counts.token_counts(docs), quality_rules.quality_rules(docs)):
        assert result.count() >= len(rows)
    bench = spark.createDataFrame([(1, t), (None, t)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench).collect()} == {1, 2, 3}


def test_empty_tables(spark):
    empty = make(spark, []).select("doc_id", "text", "lang", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [
        quality_classifier.quality_scores(empty, labels), minhash_dedup.near_duplicates(empty), line_dedup.remove_repeated_lines(empty), line_dedup.line_dedup_report(empty),
        packing.pack_sequences(empty), lm_scoring.cross_entropy_difference(empty, labels), token_counts.token_counts(empty), decontamination.contaminated(empty, bench),
        run_length_index.remove_repeats(empty), quality_rules.quality_rules(empty), secret_scan.secrets(empty),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_word_kernel():
    for text in ("", " ", "a", " a b\x0bc d\n", "ab c"):
        data = np.frombuffer(("x" + text).encode(), dtype=np.uint8)
        start, end, first = kernels.words(data, np.array([0, 1, len(data)]))
        assert [bytes(data[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["x", *words(text)]
        assert list(first) == [0, 1, 1 + len(words(text))]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept, name
        if name == "minhash_dedup":
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
            assert set(ids) == {i for i, (_, _, k) in want.items() if k}
        kept = set(ids)
        docs = corpus_pipeline.common.materialize(after, "test")
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality int, __row string, __kept boolean, key long, item_id long, score double, predicted int"


def odd_documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, len(t or ""), 1, "r", None, 7, 8, 0.5, 0) for i, t in rows], ODD)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_on_odd_rows(spark, sf_dir, stage):
    """Nulls, empty and very long texts, repeated rows and ids, columns with the operators' names, then an empty table."""
    import corpus_pipeline

    rng = random.Random(17)
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(words(r.text)) > 12)
    good = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("quality = 1").orderBy("doc_id").limit(4).collect()]
    line = "this line of eight words comes here again"
    long = " ".join(sentence(rng, 500) for _ in range(60))
    rows = [(None, None), (None, good[0]), (1, None), (2, ""), (3, " \n "), (4, good[1]), (4, good[1]), (5, good[1]), (6, f"{line}\n{good[2]}"), (7, f"{good[3]}\n{line}\nend"), (8, long), (9, f"{item} {sentence(rng, 9)}"), (10, f"{sentence(rng, 400)} {item}"), (4, sentence(rng, 60))]
    docs = odd_documents(spark, rows)
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, sf_dir)
    none = run(spark, docs.limit(0), sf_dir)
    assert none.count() == 0 and none.columns == out.columns
    if name == "packing":
        assert out.agg({"length": "sum"}).first()[0] > 30_000 and {r.doc_id for r in out.collect()} == {i for i, _ in rows}
        return
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    left = sorted((r for r in rows if r not in got), key=str)
    if name == "quality_classifier":
        assert all(r in rows for r in got) and {(None, good[0]), (4, good[1]), (5, good[1])} <= set(got)
    if name == "line_dedup":
        want = brute_maximal([r for r in rows if r[0] not in (4, None)] + [(4, good[1])])
        assert sorted(t for i, t in got if i == 4) == sorted(t for i, t in rows if i == 4)
        assert len(got) == len(rows) and {i: t for i, t in got if i not in (4, None)} == {i: want[i] if t is not None else None for i, t in rows if i not in (4, None)}
        assert out.where("n_chars != length(text)").isEmpty()
    if name == "minhash_dedup":
        assert left == [(5, good[1])]
    if name == "decontamination":
        assert [i for i, _ in left] == [10, 9]


def test_queries_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


def test_quality_scores_equal_plain_compression(spark):
    """Every score computed anew: whole texts in blocks, with fresh compressors over the model's dictionaries, and the logistic function."""
    import zstandard

    rng = random.Random(8)
    good, bad = [rng.choice(WORDS) + str(k % 9) for k in range(80)], [f"#{rng.randrange(10**6)}!" for _ in range(80)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(5, 900)))) for i in range(60)] + [(90, None), (91, ""), (92, "été " * 20_000), (7, "again"), (None, "x")]
    docs = make(spark, rows)
    model = quality_classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))

    def size(raw, dictionary):
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(made.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024))

    want = []
    for i, text in rows:
        raw = (text or "").encode()
        x = (size(raw, model.bad) - size(raw, model.good)) / len(raw) if raw else 0.0
        want.append((i is None, i or 0, 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * x)))))
    got = [(r.doc_id is None, r.doc_id or 0, r.score) for r in quality_classifier.score(docs, model).collect()]
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for a, b in zip(sorted(got), sorted(want), strict=True))
