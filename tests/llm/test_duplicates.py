"""Line, substring, near-duplicate and embedding operators against brute force, with odd rows in the table."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import embedding_join as E
from lexispark.llm import ngram_join as N
from lexispark.llm import substring_dedup as D
from lexispark.llm.line_dedup import drop_repeated_lines, keep_what_is_left
from lexispark.llm.substring_dedup import cut_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark string, node string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "m", "n") for i, t in rows], SCHEMA)


def documents(seed, n=120):
    """Random texts over few words, copies, edited copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            held = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                held[rng.randrange(len(held))] = rng.choice(words)
            texts.append(" ".join(held))
        else:
            held = [rng.choice(words) + ("\n" if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 80))]
            if rng.random() < 0.4:
                at = rng.randrange(len(held) + 1)
                held[at:at] = passage[: rng.randint(10, 30)]
            texts.append(" ".join(held))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, "  \n "), (1003, "one"), (1004, "one"), (1005, "one two three four"), (1006, "x " * 5000), (1007, "x " * 4000)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substrings(spark, monkeypatch):
    for seed, block, bits, sent in ((1, 6 << 20, 64, 9), (2, 2000, 64, 9), (3, 2000, 7, 200_000), (3, 2000, 7, 0)):
        monkeypatch.setattr(D, "SENT", sent)
        rows = documents(seed)
        first = {}
        for i, t in rows:
            w = split(t)
            for k in range(len(w) - 12):
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
        want = []
        for i, t in rows:
            w = split(t)
            gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
            want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
        found = cut_repeats(table(spark, rows), block_bytes=block, bucket_bytes=2 * block, bits=bits).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in found) == sorted(want)
        for r in found:
            words, of = split(dict(rows)[r.doc_id]), dict(rows)
            assert len({k for s in r.spans for k in range(s.start, s.start + s.length)}) == r.n_removed
            for s in r.spans:
                there = split(of[s.source])[s.position : s.position + s.length]
                assert s.length >= 13 and s.source < r.doc_id and there == words[s.start : s.start + s.length]


@pytest.mark.parametrize("few", [0, 32])
def test_greedy_factors_are_the_longest(monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    rng = random.Random(few)
    for k in range(60):
        pool = [b"a", b"b"] if k % 2 else [b"a", b"b", b"c", b"\xff"]
        source = [rng.choice(pool) for _ in range(rng.randint(0, 60))] if k % 3 else [b"a"] * rng.randint(0, 90)
        words = [rng.choice(pool) for _ in range(rng.randint(0, 40))] + source[5:30] + [b"z"] + source[10:50]
        have = {tuple(source[i : i + n]) for i in range(len(source)) for n in range(1, len(source) - i + 1)}
        want, i = [], 0
        while i + 4 <= len(words):
            n = max((n for n in range(4, len(words) - i + 1) if tuple(words[i : i + n]) in have), default=0)
            if n:
                want.append((i, n))
                i += n - 4
            i += 1
        found = D.Reference(source, 4).factors(words)
        assert [(a, n) for a, n, _ in found] == want
        assert all(source[p : p + n] == words[a : a + n] for a, n, p in found)


def test_substrings_of_odd_tables(spark):
    assert cut_repeats(table(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(20))
    found = sorted((tuple(r)[:3] for r in cut_repeats(table(spark, [(5, long), (5, long), (None, long), (9, long)])).collect()), key=str)
    assert found == sorted([(5, 20, 0), (5, 20, 0), (None, 20, 0), (9, 20, 20)], key=str)
    # very many rows without an id or a text, and an id that a double can't hold
    big = (1 << 53) + 1
    found = cut_repeats(table(spark, [(None, long)] * 20_000 + [(7, None)] * 20_000 + [(big, None), (8, long), (big + 1, long)]), block_bytes=20_000)
    got = found.groupBy("doc_id", "n_words", "n_removed", "text").count().collect()
    assert {tuple(r) for r in got} == {(None, 20, 0, long, 20_000), (7, 0, 0, "", 20_000), (big, 0, 0, "", 1), (8, 20, 0, long, 1), (big + 1, 20, 20, "", 1)}


def plain_lines(rows, run=3):
    places = {}
    split_rows = [(i, t.split("\n")) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None]
    gone = {i: set() for i, _ in rows}
    for i, lines in split_rows:
        for k in range(len(lines) - run + 1):
            key = tuple(lines[k : k + run])
            if key in places:
                gone[i] |= set(range(k, k + run))
            else:
                places[key] = (i, k)
    return {i: (0, 0, None) if t is None else (len(t.split("\n")), len(gone[i]), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in rows}


@pytest.mark.parametrize("run", [1, 3, 5])
def test_lines(spark, run):
    rng = random.Random(run)
    lines = [f"line {i}" for i in range(12)] + ["", ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(80)] + [(100, None), (101, ""), (102, "same\n" * 3000)]
    found = drop_repeated_lines(table(spark, rows), run).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found} == plain_lines(rows, run)
    assert all(r.n_chars == len(r.text or "") for r in found)


def test_lines_of_odd_tables(spark):
    assert drop_repeated_lines(table(spark, [])).count() == 0
    twice = drop_repeated_lines(table(spark, [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (None, "q\na\nb\nc")]))
    assert sorted((str(r.doc_id), r.n_removed) for r in twice.collect()) == [("1", 3), ("1", 3), ("None", 0)]


def test_lines_of_a_very_long_text(spark):
    """200,000 lines in one document: work in proportion to the lines."""
    import time

    lines = [f"line {i}" for i in range(100_000)]
    text = "\n".join(lines + lines)
    rows = spark.createDataFrame([(1, text), (2, "\n".join(lines[5:9] + ["own"]))], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in drop_repeated_lines(rows).select("doc_id", "n_lines", "n_removed").collect()}
    assert found == {1: (200_000, 100_000), 2: (5, 4)} and time.time() - began < 60
    assert {r.doc_id: r.n_chars for r in keep_what_is_left(rows.withColumn("n_chars", F.length("text").cast("long"))).collect()} == {1: len("\n".join(lines)), 2: 3}


def test_lines_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", 9, "x", 7), (2, "a\nb\nc", 9, "y", 7), (3, "a\nb\nc\nd", 9, "z", 7)], "doc_id long, text string, n_lines int, starts string, n_removed int")
    found = sorted(drop_repeated_lines(rows).collect())
    assert [(r.doc_id, r.text, r.n_lines, r.n_removed, r.starts) for r in found] == [(1, "a\nb\nc", 3, 0, "x"), (2, "", 3, 3, "y"), (3, "d", 4, 3, "z")]
    kept = keep_what_is_left(rows)
    assert kept.columns == rows.columns and sorted((r.doc_id, r.text, r.n_lines) for r in kept.collect()) == [(1, "a\nb\nc", 9), (3, "d", 9)]


def components(nodes, links):
    low = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def jaccard_links(rows):
    sets = {}
    for i, t in rows:
        w = split(t)
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    return [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("seed, tile", [(3, 512), (4, 8)])
def test_near_duplicates(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rows = documents(seed)
    links = jaccard_links(rows)
    low = components([i for i, _ in rows], links)
    want = sorted((i, sum(i in p for p in links), low[i]) for i, _ in rows)
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in N.near_duplicates(table(spark, rows)).collect()) == want
    kept = N.keep_one_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if low[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    assert N.near_duplicates(table(spark, [])).count() == 0 and N.keep_one_each(table(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(5, long), (5, long), (7, long + " end"), (None, long), (8, None), (8, None)]
    found = sorted(((r.doc_id, r.n_links, r.class_id) for r in N.near_duplicates(table(spark, rows)).collect()), key=str)
    assert found == sorted([(5, 3, 5), (5, 3, 5), (7, 3, 5), (None, 3, 5), (8, 0, 8), (8, 0, 8)], key=str)
    assert sorted(str(r.doc_id) for r in N.keep_one_each(table(spark, rows)).collect()) == ["5", "8"]


def test_one_of_near_copies_under_one_id_and_rows_with_maps(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(5, long, {"a": 1}), (5, long, {"a": 1}), (5, long + " end", {"a": 2}), (6, "other words", {}), (6, "other words", {}), (6, "more text", {}), (7, None, {}), (7, None, {}), (None, "alone", {})], "doc_id long, text string, m map<string,int>")
    kept = N.keep_one_each(rows)
    assert kept.columns == rows.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len([r for r in got if r[0] == 5]) == 1 and [r for r in got if r[0] != 5] == sorted([(6, "other words"), (6, "more text"), (7, None), (None, "alone")], key=str)


def test_posterior_bound():
    for n in (16, 64, 128):
        m = N.fewest_matches(n)
        p = [sum(N.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1)) for k in (m - 1, m)]
        assert p[0] < 1e-9 <= p[1]


def test_overlaps_both_ways(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert N._overlaps(sets, a, b).tolist() == want
    assert N._overlaps(sets, a[:3], b[:3]).tolist() == want[:3]


VECTORS = "vec_id long, embedding array<float>, label int, tile int, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "v") for i, v, k in rows], VECTORS)


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(E, "CELL", tile)
    rng = np.random.default_rng(7)
    rows, held = [], []
    for i in range(300):
        if held and rng.random() < 0.6:
            v = held[rng.integers(len(held))] + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.3, 0.4, 0.6])
        else:
            v = rng.normal(size=64)
        held.append(v)
        rows.append((i, [float(x) for x in v * rng.choice([1, 5])], int(rng.integers(3))))
    nan = [float("nan")] * 64
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, nan, 1), (403, rows[0][1], None), (404, [None] + [1.0] * 63, 1), (405, [], 1), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, rows[3][1], rows[3][2])]
    fine = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a, b in itertools.combinations(sorted(fine), 2) if fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] / np.linalg.norm(fine[a][0]) / np.linalg.norm(fine[b][0]) >= 0.93]
    low = components([r[0] for r in rows], links)
    want = sorted((i, sum(i in p for p in links), low[i], low[i] == i) for i, _, _ in rows)
    assert len(links) > 50
    assert sorted(tuple(r) for r in E.near_vectors(vectors(spark, rows)).collect()) == want


def test_no_vectors(spark):
    assert E.near_vectors(vectors(spark, [])).count() == 0
    (r,) = E.near_vectors(vectors(spark, [(3, None, 1)])).collect()
    assert tuple(r) == (3, 0, 3, True)
    two = E.near_vectors(vectors(spark, [(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1)])).collect()
    assert len(two) == 2 and {r.component_id for r in two} == {3}


def test_hash_of_kept_words(spark):
    r = cut_repeats(table(spark, [(1, "a \n b\t")])).select(F.sha2("text", 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"a b").hexdigest()


def plain_kept(rows, run=3, words=50, chars=400):
    """{doc_id: text left}: repeated runs, short ones if long in words or characters, and copies of short documents."""
    split_rows = [(i, t.split("\n")) for i, t in sorted(rows) if t is not None]
    seen, gone = set(), {i: set() for i, _ in split_rows}
    for i, lines in split_rows:
        spans = [(k, n) for n in range(1, run + 1) for k in range(len(lines) - n + 1)]
        for k, n in spans:
            held = lines[k : k + n]
            if n < run and sum(len(x.split()) for x in held) < words and sum(map(len, held)) < chars:
                continue
            if tuple(held) in seen:
                gone[i] |= set(range(k, k + n))
            seen.add(tuple(held))
        if len(lines) < run:
            if ("whole", *lines) in seen:
                gone[i] = set(range(len(lines)))
            seen.add(("whole", *lines))
    out = {i: "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) for i, lines in split_rows if len(gone[i]) < len(lines)}
    return out | {i: None for i, t in rows if t is None}


def test_short_runs_that_are_long_in_words(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 24, 26, 30, 49, 50, 51, 80)] + ["", "z" * 399, "z" * 400, "\t" + "w " * 49]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(80)] + [(200, None), (201, ""), (202, "")]
    found = keep_what_is_left(table(spark, rows)).collect()
    assert {r.doc_id: r.text for r in found} == plain_kept(rows)
    one = " ".join(f"word{i}" for i in range(51))
    found = keep_what_is_left(table(spark, [(1, f"a\n{one}\nb"), (2, f"c\n{one}\nd"), (3, one), (4, "x\ny"), (5, "x\ny")]))
    assert {r.doc_id: r.text for r in found.collect()} == {1: f"a\n{one}\nb", 2: "c\nd", 4: "x\ny"}
