"""Sites, clusters, regularity, prediction: small wordlists worked out by hand."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexispark.functions.sequences import GAP, MISSING
from lexispark.operators import clusters as K
from lexispark.operators import fits as T
from lexispark.operators import metrics as M
from lexispark.operators import reconstruct as R
from lexispark.operators import sites as S
from lexispark.operators.components import connected_components
from lexispark.operators.cover import take_in
from lexispark.operators.prepare import add_structure
from lexispark.sources.wordlists import doculects, morphemes, wordlist_from_rows, write_tsv, read_wordlist

# Two small wordlists with known results (12 sites in 9 clusters, purity 0.42; 9 sites in 7 patterns). In word 9
# of FOUR the tokens are those of its alignment.
FOUR = {
    0: ["doculect", "concept", "tokens", "alignment", "cogid"],
    1: ["a", "a", "p l a", "p l a -", 1], 2: ["b", "a", "p l a t", "p l a t", 1],
    3: ["c", "a", "p l u p", "p l u p", 1], 4: ["d", "a", "p l a k", "p l a k", 1],
    5: ["a", "b", "t r a", "t r a -", 2], 6: ["b", "b", "t a t", "t - a t", 2], 7: ["c", "b", "d r ə p", "d r ə p", 2],
    9: ["a", "c", "k r a", "k r a -", 3], 11: ["c", "c", "k l ə p", "k l ə p", 3], 12: ["d", "c", "g l a k", "g l a k", 3],
    13: ["d", "f", "b u k", "b u k", 4],
}
THREE = {
    0: ["doculect", "concept", "tokens", "alignment", "cogid"],
    1: ["A", "one", "a t a w u", "a t a w u", 1], 2: ["B", "one", "a t w u", "a t - w u", 1],
    3: ["C", "one", "t a w u", "- t a w u", 1], 4: ["D", "one", "t e f u", "- t e f u", 1],
    5: ["A", "two", "s a t u", "s a t u", 2], 6: ["B", "two", "s e t u", "s e t u", 2], 7: ["C", "two", "s i t u", "s i t u", 2],
}


def prepared(spark, rows, minrefs):
    words = add_structure(morphemes(wordlist_from_rows(spark, rows)))
    langs = doculects(words)
    return words, langs, S.get_sites(words, langs, minrefs)


@pytest.fixture(scope="module")
def four(spark):
    words, langs, sites = prepared(spark, FOUR, 1)
    return words, langs, sites, K.cluster_sites(sites).cache()


def test_counts_and_purity(four):
    words, langs, sites, found = four
    assert (sites.count(), K.clusters(found).count()) == (12, 9)
    assert round(K.purity(found).first()[0], 2) == 0.42
    assert S.upper_bound(sites).first()[0] > 1
    edges = S.site_graph(sites).collect()
    ends = [(e.cogid_a, e.pos_a) for e in edges] + [(e.cogid_b, e.pos_b) for e in edges]
    assert {(r.cogid, r.pos): r.neighbours for r in S.site_degrees(sites).collect()} == {x: ends.count(x) for x in ends} and len(set(ends)) == 5


def test_lone_word_in_all_sites(four):
    words, langs, _, _ = four
    rows = {(r.cogid, r.pos): list(r.pattern) for r in S.all_sites(words, langs).collect()}
    assert len(rows) == 15 and rows[4, 1] == [MISSING, MISSING, MISSING, "u"]


def test_labels_load_back(spark, four, tmp_path):
    words, langs, _, found = four
    rows = K.add_patterns(words, found, langs)
    loaded = {r.pattern_id: (list(r.pattern), r.sites) for r in K.load_patterns(rows, langs).collect()}
    assert len(loaded) == 9 and sum(n for _, n in loaded.values()) == 12
    table = K.pattern_table(words, found, langs, "a", K.irregular_patterns(found))
    assert table.agg(F.sum("frequency")).first()[0] == 12
    write_tsv(rows, str(tmp_path / "words"))
    again = read_wordlist(spark, str(tmp_path / "words"))
    assert again.where("id = 1").first()["patterns"] == rows.where("id = 1").first()["patterns"]


def test_predictions(four):
    _, langs, _, found = four
    made = {(r.cogid, r.doculect): list(r.word) for r in K.predict_words(found, langs).collect()}
    assert set(made) == {(2, "d"), (3, "b")} and all(len(w) == 4 for w in made.values())
    assert made[3, "b"][3] == "t" and made[2, "d"][3] == "k"


def test_regularity(spark):
    _, _, sites = prepared(spark, THREE, 3)
    found = K.cluster_sites(sites)
    r = M.regularity(found, 2, 0.5).first()
    assert (r.regular_patterns, r.irregular_patterns, r.patterns) == (2, 5, 7)
    assert (r.regular_sites, r.irregular_sites, r.sites) == (4, 5, 9)
    assert (r.regular_words, r.irregular_words, r.words) == (3, 4, 7)
    assert [round(x, 2) for x in (r.patterns_share, r.sites_share, r.words_share)] == [0.29, 0.44, 0.43]


@pytest.mark.parametrize("mode, score", [("ranked", 0.75), ("squared", 0.64), ("pairs", 0.44), ("coverage", 0.75)])
def test_scores(spark, mode, score):
    rows = spark.createDataFrame([(1, list(p)) for p in ("abc", "abc", "abØ", "ØØc")] + [(2, list("ab")), (2, list("ac")), (3, list("ab"))], "g int, pattern array<string>")
    got = {r.g: r.score for r in S.score_patterns(rows, ["g"], mode).collect()}
    assert round(got[1], 2) == score and got[2] == got[3] == -1
    with pytest.raises(ValueError):
        S.score_patterns(rows, ["g"], "other")


def test_consensus(spark):
    rows = spark.createDataFrame([(1, list("aØc")), (1, list("ØbØ")), (2, list("ab")), (2, list("ac"))], "g int, pattern array<string>")
    got = {r.g: (r.consensus, r.conflicts) for r in S.consensus(rows, ["g"]).collect()}
    assert got == {1: (["a", "b", "c"], ["", "", ""]), 2: (None, ["", "*"])}


def test_density(spark):
    rows = [(i, c, cog) for i, (c, cog) in enumerate([("b", 1)] * 3 + [("c", 2)] * 3)]
    assert round(S.density(spark.createDataFrame(rows, "id int, concept string, cogid int")).first()[0], 2) == 0.67


def test_bad_structure_is_an_error(spark):
    words = morphemes(wordlist_from_rows(spark, THREE)).withColumn("structure", F.array(F.lit("c")))
    assert S.bad_structures(words).count() == 7
    with pytest.raises(Exception, match="do not match"):
        S.get_sites(words, ["A", "B", "C", "D"]).collect()


def test_irregular_marks_are_read_back(spark):
    rows = {0: ["doculect", "concept", "tokens", "alignment", "structure", "cogid"], 1: ["a", "x", "l a", "!l a", "c v", 1], 2: ["b", "x", "l a", "f/l a", "c v", 1]}
    words = morphemes(wordlist_from_rows(spark, rows))
    got = S.get_sites(words, ["a", "b"], 1).orderBy("pos").collect()
    assert [list(r.pattern) for r in got] == [[MISSING, "l"], ["a", "a"]]


def naive_clusters(sites, threshold=1):
    """The cover in plain Python, over sites of one structure at a time."""
    out = []
    for struct in sorted({s for s, _, _ in sites}):
        now = {}
        for s, key, p in sorted(sites, key=lambda x: x[1]):
            if s == struct:
                now.setdefault(p, []).append(p)

        def score(rows):
            n, m = len(rows), len(rows[0])
            if n < 2:
                return -1
            fill = [sum(r[i] != MISSING for r in rows) for i in range(m)]
            pairs = sum(f * (f - 1) / 2 for f in fill) + sum((v := sum(x != MISSING for x in r)) * (v - 1) / 2 for r in rows)
            return pairs / n / sum(f > 0 for f in fill) / m

        while True:
            queue = sorted(now.items(), key=lambda x: (score(x[1]), len(x[1])), reverse=True)
            new = {}
            before = len(queue)
            while queue:
                (head, rows), rest = queue[0], []
                for p, more in queue[1:]:
                    both = [(a, b) for a, b in zip(head, p) if MISSING not in (a, b)]
                    if all(a == b for a, b in both) and sum(a != GAP for a, _ in both) >= threshold:
                        head, rows = tuple(b if a == MISSING else a for a, b in zip(head, p)), rows + more
                    else:
                        rest.append((p, more))
                new[head] = new.get(head, []) + rows
                queue = rest
            now = new
            if len(now) == before:
                break
        out += [(struct, c, len(rows)) for c, rows in now.items()]
    return sorted(out)


def random_sites(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rng.choice("abc") for _ in range(6)]
        rows.append((rng.choice("cv"), (i, 0), tuple(MISSING if rng.random() < 0.4 else GAP if rng.random() < 0.1 else x for x in base)))
    return [r for r in rows if set(r[2]) != {MISSING}]


@pytest.mark.parametrize("block, threshold", [(K.BLOCK, 1), (K.BLOCK, 2), (7, 1), (20, 2)])
def test_clusters_against_plain_cover(spark, block, threshold):
    """The same clusters, site by site, whatever the size of blocks and stages."""
    rows = random_sites(4)
    sites = spark.createDataFrame([(k[0], k[1], s, list(p)) for s, k, p in rows], "cogid long, pos int, struct string, pattern array<string>")
    found = K.cluster_sites(sites, threshold, block=block).cache()
    got = sorted((r.struct, tuple(r.consensus), r.size) for r in K.clusters(found).collect())
    assert got == naive_clusters(rows, threshold)
    for r in found.collect():
        assert all(x in (MISSING, y) for x, y in zip(r.pattern, r.consensus))
    assert found.count() == len(rows)


@pytest.mark.parametrize("seed", range(6))
def test_stages_and_blocks_take_in_as_one_by_one(seed):
    """Blocks that meet the stages in order leave the heads, and each pattern at the head, that one long run does."""
    rng = np.random.default_rng(seed)
    codes, size = rng.integers(0, 4, (150, 5)), int(rng.integers(1, 40))
    heads, places = take_in(codes, codes[:0], len(codes), 1)
    stages, found = [], np.full(len(codes), -1)
    for low in range(0, len(codes), size):
        left = np.arange(low, min(low + size, len(codes)))
        for s in range(len(codes)):
            if not len(left):
                break
            if s == len(stages):
                stages.append(codes[:0])
            stages[s], at = take_in(codes[left], stages[s], size, 1)
            found[left[at >= 0]] = s * size + at[at >= 0]
            left = left[at < 0]
    assert (np.concatenate(stages) == heads).all() and (found == places).all()


@pytest.mark.parametrize("mode", ["ranked", "pairs", "squared", "coverage"])
def test_clusters_are_ordered_by_their_score(spark, mode):
    """What is summed up for a cluster scores it as all its patterns do."""
    rows = random_sites(5, 80)
    sites = spark.createDataFrame([(k[0], k[1], s, list(p)) for s, k, p in rows], "cogid long, pos int, struct string, pattern array<string>")
    found = K.cluster_sites(sites, mode=mode).cache()
    want = {(r.struct, tuple(r.consensus)): r.score for r in S.score_patterns(found, ["struct", "consensus"], mode).collect()}
    kinds = found.groupBy("struct", "consensus", "pattern").agg(F.count("*").alias("n")).select("*", *K._fill(MISSING))
    filled = F.array(*[F.sum(F.get("filled", F.lit(i))) for i in range(6)]).alias("filled")
    sums = kinds.groupBy("struct", "consensus").agg(F.sum("n").alias("n"), filled, F.sum("row_pairs").alias("row_pairs"), F.sum("squares").alias("squares"))
    got = {(r.struct, tuple(r.consensus)): r.s for r in sums.select("struct", "consensus", K._fill_score(mode, 6).alias("s")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def pairs_that_fit(rows, threshold=1):
    """Places of rows (struct, pattern, ...) that fit, with their matches."""
    for i, (s, p, *_) in enumerate(rows):
        for j, (t, q, *_) in enumerate(rows):
            same = sum(a == b and a not in (MISSING, GAP) for a, b in zip(p, q))
            if s == t and same >= threshold and all(a == b or MISSING in (a, b) for a, b in zip(p, q)):
                yield i, j, same


def random_patterns(seed, n=200, sounds=("a", "b", GAP, MISSING, MISSING), width=5):
    rng = random.Random(seed)
    return [(rng.choice("cv"), tuple(rng.choice(sounds) for _ in range(width)), rng.randint(1, 9)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0, 1, 2])
def test_fitting_against_all_pairs(spark, threshold):
    """Blocks by the sound of one doculect give what comparing every pattern with every other gives."""
    rows = random_patterns(6)
    frame = spark.createDataFrame([(s, list(p), n) for s, p, n in rows], "struct string, pattern array<string>, n long")
    found = T.fitting(frame, frame, {"n": "n", "rows": None}, {"top": "n"}, threshold)
    got = {(r.struct, tuple(r.pattern)): (r.n, r.rows, r.top, r.matched) for r in found.collect()}
    near = defaultdict(list)
    for i, j, same in pairs_that_fit(rows, threshold):
        near[i].append((rows[j][2], same))
    assert got == {rows[i][:2]: (sum(n for n, _ in x), len(x), max(n for n, _ in x), sum(m for _, m in x)) for i, x in near.items()}


@pytest.mark.parametrize("block", [3, 17])
def test_blocks_of_any_size(spark, block):
    """Each pair of patterns that fits meets in just one pair of blocks."""
    rows = random_patterns(7, 90)
    frame = spark.createDataFrame([(s, list(p), i) for i, (s, p, _) in enumerate(rows)], "struct string, pattern array<string>, n long")
    both = lambda asked, held: pd.DataFrame([(i, j) for i in asked["n"] for j in held["n"]], columns=["i", "j"]).astype("int64")
    met = Counter((r.i, r.j) for r in T.meet(frame, frame, both, "i long, j long", block=block).collect())
    assert max(met.values()) == 1 and {(i, j) for i, j, _ in pairs_that_fit(rows)} <= set(met)


def test_many_doculects(spark):
    """4,000 patterns over 20 doculects, of which few attest the same."""
    rows = random_patterns(8, 4000, ("a", "b", "c", "d", "e", GAP, MISSING, MISSING, MISSING), 20)
    frame = spark.createDataFrame([(s, list(p), n) for s, p, n in rows], "struct string, pattern array<string>, n long")
    got = {(r.struct, tuple(r.pattern)): r.n for r in T.fitting(frame, frame, {"n": "n"}).collect()}
    codes = np.array([[["\0", GAP, "a", "b", "c", "d", "e"].index("\0" if x == MISSING else x) for x in p] for _, p, _ in rows])
    kind, n = np.array([s == "c" for s, *_ in rows]), np.array([r[2] for r in rows])
    for i in range(0, 4000, 100):
        there = (codes != 0) & (codes[i] != 0)
        fit = (kind == kind[i]) & ~(there & (codes != codes[i])).any(1) & ((codes == codes[i]) & (codes > 1)).any(1)
        assert got.get(rows[i][:2], 0) == n[fit].sum()


def test_purity_and_predictions_against_all_pairs(spark):
    """Both from every pair of patterns, over clusters of which each holds several patterns."""
    rng = random.Random(9)
    sites, fill = [], {}
    for i, (s, p, _) in enumerate(random_patterns(9, 120, ("a", "b", "c", GAP, MISSING, MISSING), 4)):
        whole = tuple(x if x != MISSING else rng.choice(["a", "b", MISSING]) for x in p)
        sites.append((i, 0, s, p, fill.setdefault((s, p), whole)))
    frame = spark.createDataFrame([(c, k, s, list(p), list(w)) for c, k, s, p, w in sites], "cogid long, pos int, struct string, pattern array<string>, consensus array<string>")
    near = defaultdict(list)
    for i, j, _ in pairs_that_fit([(s, p) for _, _, s, p, _ in sites]):
        if i != j:
            near[i].append(sites[j][4])
    share = lambda x: sum(n * n for k, n in Counter(x).items() if k != MISSING) ** 0.5 / len(x)
    want = sum(sum(share([w[c] for w in near[i]]) for c in range(4)) / 4 if near[i] else 0 for i in range(120)) / 120
    assert abs(K.purity(frame).first()[0] - want) < 1e-9
    heads = Counter((s, w) for *_, s, _, w in sites)
    votes = Counter()
    for c, k, s, p, _ in sites:
        for (t, w), n in heads.items():
            if s == t and any(a == b and a not in (MISSING, GAP) for a, b in zip(p, w)) and all(a == b or MISSING in (a, b) for a, b in zip(p, w)):
                for lang, (a, b) in enumerate(zip(p, w)):
                    if a == MISSING != b:
                        votes[c, k, lang, b] += n
    found = K.ranked_predictions(frame, list("ABCD")).collect()
    assert {(r.cogid, r.pos, r.lang, r.sound): r.weight for r in found} == dict(votes) and len(found) == len(votes)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_hashes(spark):
    big = [(2**63 - 1 - i, 2**62 + i) for i in range(20)] + [(-(2**63) + i, 2**62) for i in range(20)]
    got = connected_components(spark.createDataFrame(big, "u long, v long"))
    assert got.count() == len({x for e in big for x in e})


def test_partial_cognates_and_metrics(spark):
    rows = {
        0: ["doculect", "concept", "cogids", "morphemes"],
        1: ["a", "A", "1 2", "a _suf"], 2: ["b", "A", "1 2", "a _suf"], 3: ["c", "A", "3 4 1", "_suf d a"], 4: ["d", "A", "4 5", "d e"],
        5: ["a", "B", "1 6", "a f"], 6: ["b", "B", "1 6", "a f"], 7: ["c", "C", "7 8 1", "g h a"], 8: ["d", "C", "8 9", "h i"],
    }
    words = wordlist_from_rows(spark, rows)
    got = [(r.concept, round(r.score, 3)) for r in M.cross_semantic_statistics(words).collect()]
    assert got == [("C", 0.167), ("B", 0.5), ("A", 0.625)]
    assert [round(r.score, 3) for r in M.cross_semantic_statistics(words, ignore_affixes=False).collect()][-1] == 0.5
    strict = spark.createDataFrame([("x", 2, 1), ("x", 3, 1), ("x", 2, 1), ("x", 4, 1)], "concept string, strict int, loose int")
    r = M.compare_cognate_sets(strict, "strict", "loose").first()
    assert (r.precision, r.recall) == (1.0, 0.375)


def test_empty_wordlist(spark):
    words = spark.createDataFrame([], "id long, m_idx int, doculect string, concept string, cogid long, tokens array<string>, alignment array<string>, structure array<string>")
    sites = S.get_sites(words, ["a", "b"])
    assert sites.count() == 0 and K.cluster_sites(sites).count() == 0


def test_sites_read_the_words_once(spark, tmp_path):
    """Neither sites nor one-hot rows make their input anew for each thing they ask of it."""
    rows = [(c * 10 + i, 0, f"L{i}", c, [x, "a", "-"][: 3 - c % 2], [x, "a"], ["c", "v"]) for c in range(4) for i, x in enumerate("ptk")]
    spark.createDataFrame([*rows, (99, 0, "L1", 9, ["-"], ["s", "o"], [])], "id long, m_idx int, doculect string, cogid long, alignment array<string>, tokens array<string>, structure array<string>").write.parquet(f"{tmp_path}/words")
    words, langs = spark.read.parquet(f"{tmp_path}/words"), ["L0", "L1", "L2"]
    scans = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("FileScan")
    sites, every = S.get_sites(words, langs), S.all_sites(words, langs)
    assert scans(sites) == scans(every) == 1
    assert scans(R.one_hot(sites.withColumnRenamed("pattern", "row"), 3)) == 0
    found = {(r.cogid, r.pos): (r.struct, "".join(r.pattern)) for r in sites.collect()}
    assert found == {(c, p): [("c", "ptk"), ("v", "aaa"), ("+", "---")][p] for c in range(4) for p in range(3 - c % 2)}
    assert {(r.pos, "".join(r.pattern)) for r in every.where("cogid = 9").collect()} == {(0, "ØsØ"), (1, "ØoØ")}


def test_links_of_patterns_in_blocks(spark):
    """Links are found in blocks, both ways, by two tables alone: entries alike and none against, gaps counting as entries."""
    from lexispark.functions import alignment

    draw = random.Random(3)
    held = sorted({(k, tuple(draw.choice("ab-Ø") for _ in range(5))) for k in range(2) for _ in range(150)})
    rows = spark.createDataFrame([(k, n, list(p)) for n, (k, p) in enumerate(held)], "split int, node long, p array<string>")
    fits = lambda a, b, t: sum(x == y != "Ø" for x, y in zip(a, b)) >= t and all(x == y or "Ø" in (x, y) for x, y in zip(a, b))
    for threshold in (1, 2):
        wanted = {(i, j) for i, (k, p) in enumerate(held) for j, (m, q) in enumerate(held) if i != j and k == m and fits(p, q, threshold)}
        got = [tuple(r) for r in R.linked(rows, ["split"], threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
        codes = np.array([["Øab-".index(x) for x in p] for k, p in held if k == 0])
        own = {(i, j) for i, j in wanted if max(i, j) < len(codes)}
        for size in (256, 7):
            bits = alignment.links_as_bits(codes, threshold, size)
            assert {(i, j) for i in range(len(codes)) for j in range(len(codes)) if bits[i] >> j & 1} == own
