"""Correspondences, clusters with what must stay apart, Markov clusters and borrowings, against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark.functions import alignment as A
from lexispark.functions import phonetics as P
from lexispark.operators import borrowing as B
from lexispark.operators.markov import markov_clusters
from lexispark.sources.wordlists import wordlist_from_rows

WORDS = {"A": ["p a t", "t i k", "m u n a", "s a + t o", "k u"], "B": ["b a d", "d i k", "m u n", "s a + d o", "k u"]}


def tables(spark):
    kinds = spark.createDataFrame([("F", d, w.split(), 1 + i % 2) for d, ws in WORDS.items() for i, w in enumerate(ws)], "family string, doculect string, tokens array<string>, n long")
    pairs = spark.createDataFrame([("F", "A", "B", a.split(), b.split(), 1 + i) for i, (a, b) in enumerate(zip(*WORDS.values()))], "family string, da string, db string, a array<string>, b array<string>, n long")
    return pairs, kinds


@pytest.mark.parametrize("options", [{}, {"vscale": 1.0, "ratio": (1.0, 3.0), "smooth": 0.5}, {"restricted_chars": "", "modes": (B.Mode("global", -2.0, 1.0),)}, {"restricted_chars": "T_", "threshold": 0.0}])
def test_correspondences(spark, options):
    """The table of five words in two doculects, counted alignment by alignment."""
    runs = 37
    pairs, kinds = tables(spark)
    found = {(r.da, r.db, (r.x, r.p), (r.y, r.q)): r.weight for r in B.correspondences(pairs, kinds, runs, 5, **options).collect()}
    o = {"vscale": 0.5, "ratio": (2.0, 1.0), "smooth": 1.0, "restricted_chars": "_", "modes": B.MODES, "threshold": 0.7} | options
    drawn = {(r.doculect, r.run): list(r.tokens) for r in B.random_words(kinds, runs, 5).collect()}
    assert len(drawn) == 2 * runs
    number = {d: {tuple(w.split()): 1 + i % 2 for i, w in enumerate(ws)} for d, ws in WORDS.items()}
    near = [(a.split(), b.split(), 1 + i) for i, (a, b) in enumerate(zip(*WORDS.values()))]
    near = [x for x in near if P.distances([x[0]], [x[1]], o["modes"][0].gop, o["modes"][0].extend, o["modes"][0].name)[0] <= o["threshold"]]
    held = {("A", "B"): near} | {(d, d): [(list(w), list(w), n) for w, n in number[d].items()] for d in "AB"}

    def cells(some):
        out = Counter()
        for m in o["modes"]:
            for a, b, n in some:
                for cell in P.align_pairs([a], [b], m.gop, m.extend, m.name, columns=True)[1][0]:
                    out[cell] += n / len(o["modes"])
        return out

    want = {}
    for (da, db), some in held.items():
        if not some:
            continue
        attested, size = cells(some), sum(n for _, _, n in some)
        chance = cells([(drawn[da, r], drawn[db, (r + 1) % runs], 1) for r in range(runs)])
        for x, y in {*attested, *chance}:
            gap = "-" in (x[0], y[0])
            plain = -abs(o["modes"][0].gop) * P.WEIGHTS[x[1] or y[1]] if gap else P.alike(x, y)
            if {x[1], y[1]} & set(o["restricted_chars"].replace("_", "+")):
                weight = plain if gap or x[1] == y[1] else P.NEVER
            else:
                odds = math.log2((attested[x, y] + o["smooth"]) / (chance[x, y] * size / runs + o["smooth"]))
                r, d = o["ratio"]
                weight = (r * odds + d * plain) / (r + d) * (o["vscale"] if x[1] in "XYZ" and y[1] in "XYZ" and not gap else 1)
            want[da, db, x, y] = weight
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_random_words_follow_the_chain(spark):
    _, kinds = tables(spark)
    drawn = B.random_words(kinds, 2000, 1).collect()
    assert Counter((r.family, r.doculect) for r in drawn) == {("F", "A"): 2000, ("F", "B"): 2000}
    assert {tuple(r.tokens) for r in drawn} == {tuple(r.tokens) for r in B.random_words(kinds.repartition(7), 2000, 1).collect()}
    first = Counter(r.tokens[0] for r in drawn if r.doculect == "A")
    whole = {"p": 1, "t": 2, "m": 1, "s": 2, "k": 1}  # with the numbers of the words
    assert set(first) == set(whole) and all(abs(first[x] / 2000 - n / 7) < 0.05 for x, n in whole.items())


def agglomerated(far, sizes, threshold, linkage, apart):
    """Clusters joined one by one, their distances from all pairs of items."""
    groups = [[i] for i in range(len(far))]

    def between(g, h):
        pairs = [(x, y) for x in g for y in h]
        if any(apart[x][y] for x, y in pairs):
            return math.inf
        if linkage == "upgma":
            return sum(far[x][y] * sizes[x] * sizes[y] for x, y in pairs) / sum(sizes[x] * sizes[y] for x, y in pairs)
        return (min if linkage == "single" else max)(far[x][y] for x, y in pairs)

    while len(groups) > 1:
        d, a, b = min((between(g, h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        if d > threshold:
            break
        groups[a] = sorted(groups[a] + groups.pop(b))
        groups.sort()
    return sorted(map(tuple, groups))


@pytest.mark.parametrize("linkage", ["upgma", "single", "complete"])
@pytest.mark.parametrize("seed", range(3))
def test_clusters_with_items_apart(seed, linkage):
    rng, n = random.Random(seed), 14
    far, apart = np.zeros((n, n)), np.zeros((n, n), bool)
    for i, j in itertools.combinations(range(n), 2):
        far[i, j] = far[j, i] = rng.random()
        apart[i, j] = apart[j, i] = rng.random() < 0.1
    sizes = np.array([rng.randint(1, 3) for _ in range(n)])
    for threshold in (0.2, 0.4, 0.6):
        heads = A.flat_clusters(far, sizes, threshold, linkage, apart.copy())
        assert sorted({tuple(np.flatnonzero(heads == h).tolist()) for h in heads}) == agglomerated(far, sizes, threshold, linkage, apart)


def dense_markov(n, edges, inflation=2.0, least=1e-4, tolerance=1e-5):
    m = np.zeros((n, n))
    for u, v, w in edges:
        m[u, v] = m[v, u] = max(m[u, v], w)
    m += np.diag(m.max(0))
    m /= np.maximum(m.sum(0), 1e-300)
    for _ in range(100):
        new = m @ m
        new = (new / np.maximum(new.max(0), 1e-300)) ** inflation
        new[new < least] = 0
        new /= np.maximum(new.sum(0), 1e-300)
        done, m = np.abs(new - m).max() <= tolerance, new
        if done:
            break
    reach = list(range(n))
    for _ in range(n):
        for i, j in zip(*np.nonzero(m)):
            reach[i] = reach[j] = min(reach[i], reach[j])
    linked = {x for u, v, _ in edges for x in (u, v)}
    return {i: reach[i] for i in linked}


@pytest.mark.parametrize("seed", range(2))
def test_markov_clusters(spark, seed):
    """Random graphs of blocks that hang together, against dense matrices."""
    rng, n = random.Random(seed), 30
    edges = [(i, j, round(rng.uniform(0.2, 1), 3)) for i, j in itertools.combinations(range(n), 2) if rng.random() < (0.7 if i // 6 == j // 6 else 0.03)]
    df = spark.createDataFrame(edges + [(j, i, w / 2) for i, j, w in edges[:5]] + [(3, 3, 9.0)], "u long, v long, weight double")
    found = {r.node: r.cluster for r in markov_clusters(df).collect()}
    want = dense_markov(n, edges)
    assert found == want and 1 < len(set(want.values())) < n
    assert markov_clusters(df.limit(0)).count() == 0


def wordlist(spark, forms):
    """forms: (doculect, concept, family, tokens)"""
    return wordlist_from_rows(spark, {0: ["doculect", "concept", "family", "tokens"]} | {i + 1: list(f) for i, f in enumerate(forms)})


def test_morphemes_of_one_word_never_share_an_id(spark):
    """A reduplicated word, and words that have its morpheme once."""
    rows = wordlist(spark, [("A", "x", "F", "k a + k a"), ("B", "x", "F", "k a"), ("C", "x", "F", "k a + k a"), ("D", "x", "F", "n o + k a")])
    for method, clusters in itertools.product(("sca", "edit", "lexstat"), ("upgma", "single", "complete", "mcl")):
        if method == "sca" or clusters == "upgma":
            ids = {r.id: list(r.autocogids) for r in B.internal_cognates(rows, method, partial=True, runs=50, cluster_method=clusters).collect()}
            assert all(len(set(x)) == len(x) for x in ids.values()), (method, clusters)
            if clusters != "mcl":
                assert ids[1] == ids[3] and ids[2][0] == ids[1][0] and ids[4][1] in ids[1]


def test_partial_cognates_by_hand(spark):
    """Against pairs of closest morphemes and clusters with the morphemes of a word apart, in plain Python."""
    rng = random.Random(2)
    pool = ["".join(rng.choice("ptkmnsl") + rng.choice("aiu") for _ in range(rng.randint(1, 2))) for _ in range(8)]
    forms = [("ABCD"[i % 4], f"c{i % 3}", "F", " + ".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    got = {r.id: list(r.autocogids) for r in B.internal_cognates(wordlist(spark, forms), "sca", 0.4, partial=True).collect()}
    numbers, want = {}, {}
    groups = []
    for concept in ("c0", "c1", "c2"):
        kinds = {}
        for i, f in enumerate(forms):
            if f[1] == concept:
                kinds.setdefault((f[0], f[3]), [i + 1, 0])[1] += 1
        nodes = sorted((first, m, d, part.split(), n) for (d, w), (first, n) in kinds.items() for m, part in enumerate(w.split(" + ")))
        far = np.ones((len(nodes), len(nodes)))
        for a, b in itertools.combinations(sorted({x[0] for x in nodes}), 2):
            sides = [[k for k, x in enumerate(nodes) if x[0] == w] for w in (a, b)]
            d = {(i, j): P.distances([nodes[i][3]], [nodes[j][3]])[0] for i in sides[0] for j in sides[1]}
            for i, j in d:
                key = lambda x, y: (d[x, y], abs(nodes[x][1] - nodes[y][1]))
                if min((key(i, k), k) for k in sides[1])[1] == j and min((key(k, j), k) for k in sides[0])[1] == i:
                    far[i, j] = far[j, i] = d[i, j]
        word = np.array([x[0] for x in nodes])
        heads = A.flat_clusters(far, np.array([x[4] for x in nodes]), 0.4, "upgma", word[:, None] == word[None, :])
        groups += [((x[0], x[1]), (concept, int(h)), {k for k, f in enumerate(forms, 1) if (f[0], f[1], f[3].split()) == (x[2], concept, forms[x[0] - 1][3].split())}) for x, h in zip(nodes, heads)]
    for (_, m), group, ids in sorted(groups, key=lambda g: g[0]):
        number = numbers.setdefault(group, len(numbers) + 1)
        for i in ids:
            want.setdefault(i, {})[m] = number
    assert got == {i: [x[m] for m in sorted(x)] for i, x in want.items()}


def test_cluster_methods(spark):
    forms = [(d, "x", "F", w) for d, w in zip("ABCDEFG", ["p a t", "b a t", "b a d", "m u n", "m u ŋ", "s i l o", "p a t"])]
    for method in ("upgma", "single", "complete", "mcl"):
        ids = {r.id: r.autocogid for r in B.internal_cognates(wordlist(spark, forms), "sca", cluster_method=method).collect()}
        assert ids[1] == ids[2] == ids[3] == ids[7] and ids[4] == ids[5] and len({ids[1], ids[4], ids[6]}) == 3
    with pytest.raises(ValueError):
        B.internal_cognates(wordlist(spark, forms), cluster_method="ward")


@pytest.mark.parametrize("mode", ["overlap", "global"])
def test_borrowings(spark, mode):
    """Sets linked by the mean distance of all their words, row by row."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("ptkbdgms") + rng.choice("aiu") for _ in range(2)) for _ in range(6)]
    forms = [("ABCDEF"[i % 6], f"c{rng.randrange(4)}", "FFGGHH"[i % 6], " ".join(rng.choice(pool))) for i in range(120)]
    rows = wordlist(spark, forms).withColumn("sets", F.pmod(F.xxhash64("concept", "family", F.concat_ws(" ", "tokens")), F.lit(50)))
    found = B.external_cognates(rows, "sets", "loans", 0.3, align_mode=mode).collect()
    by, family = defaultdict(list), {}
    for r in sorted(found, key=lambda r: r.id):
        by[r.concept, r.sets].append(r.tokens)
        family.setdefault((r.concept, r.sets), r.family)
    reach = {k: k for k in by}
    for a, b in itertools.combinations(sorted(by), 2):
        if a[0] == b[0] and family[a] != family[b]:
            pairs = [(x, y) for x in by[a] for y in by[b]]
            if np.mean(P.distances([p[0] for p in pairs], [p[1] for p in pairs], mode=mode)) <= 0.3:
                low, high = sorted((reach[a], reach[b]))
                reach = {k: low if v == high else v for k, v in reach.items()}
    members = Counter(reach.values())
    order = {k: n for n, k in enumerate(sorted(k for k, m in members.items() if m > 1), 1)}
    assert {r.id: r.loans for r in found} == {r.id: order.get(reach[r.concept, r.sets], 0) for r in found} and order


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    """Not Spark's shuffle partitions, which grow with the whole input, nor the bytes of a few short words, which are many pairs."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("ptkmns") + rng.choice("aiu") for _ in range(2)) for _ in range(9)]
    rows = wordlist(spark, [("ABCD"[i % 4], f"c{i % 7}", "FG"[i % 4 // 2], " ".join(rng.choice(pool))) for i in range(200)])
    want = {method: sorted((r.id, r.autocogid) for r in B.internal_cognates(rows, method, runs=600).collect()) for method in ("sca", "lexstat")}
    kinds, usual = tables(spark)[1], spark.conf.get("spark.sql.shuffle.partitions")
    aligned, seen = B._distances, []
    monkeypatch.setattr(B, "_distances", lambda pairs, *mode: seen.append(pairs.rdd.getNumPartitions()) or aligned(pairs, *mode))
    for name in ("ALIGNED", "SCORED", "LINKED"):
        monkeypatch.setattr(B, name, 20)
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        assert B.random_words(kinds, 4 * B.DRAWN).rdd.getNumPartitions() == 2
        assert all(sorted((r.id, r.autocogid) for r in B.internal_cognates(rows, method, runs=600).collect()) == want[method] for method in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert seen and min(seen) > 4
