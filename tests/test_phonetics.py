"""The model of sounds, alignment by it, and the reconstruction of a shipped wordlist."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import phonetics as P
from lexispark.functions.phonology import prosody
from lexispark.functions.phonology import sonority as sonority_of
from lexispark.operators import reconstruct
from lexispark.sources.wordlists import morphemes, wordlist_from_rows

#: A wordlist of Burmish languages with the words of their source; id, doculect, tokens, cognate sets.
BURMISH = """
1 OldBurmese | ṅ/ŋ a | 665
4 Atsi | ŋ o ⁵¹ | 665
6 Lashi | ŋ o ³¹ | 665
9 ProtoBurmish | ŋ a ¹ | 665
147 Atsi | ŋ o ʔ ⁵⁵ + m j u ʔ ²¹ | 681 3302
149 Lashi | ŋ ɔ ʔ ⁵⁵ + m j u̱ k ⁵⁵ | 681 3304
151 ProtoBurmish | ŋ a k ⁴ | 681
167 ProtoBurmish | ŋ j i ¹ | 488
283 ProtoBurmish | ŋ j u ŋ ¹ | 698
284 ProtoBurmish | ŋ j u ¹ | 699
665 Atsi | ŋ j o ʔ ²¹ | 684
667 Lashi | ŋ j ɔː ʔ ³¹ | 684
670 ProtoBurmish | ŋ j a k ⁴ | 684
733 OldBurmese | ṅ/ŋ ui̯ | 693
736 Atsi | ŋ au ⁵¹ | 693
738 Lashi | ŋ aːu ³¹ | 693
741 ProtoBurmish | ŋ u ¹ | 693
799 ProtoBurmish | ŋ j i ³ | 491
1230 Lashi | tsʰ ĕ ³³ + ŋ ³³ | 3295 666
1232 ProtoBurmish | ŋ a ³ | 667
1275 OldBurmese | ṅ/ŋ a ḥ/⁵ | 666
1278 Atsi | ŋ o ²¹ | 666
1283 ProtoBurmish | ŋ a ² | 666
2888 OldBurmese | ṅ/ŋ a n | 683
2895 ProtoBurmish | ŋ a n ¹ | 683
3109 OldBurmese | ṅ/ŋ u j | 696
3112 Atsi | ŋ u n ⁵¹ | 696
3114 Lashi | ŋ ə ³¹ | 696
3117 ProtoBurmish | ŋ ui ¹ | 696
3170 OldBurmese | ṅ/ŋ ai | 668
3174 Lashi | ŋ ɛː ³¹ | 668
3177 ProtoBurmish | ŋ ai ¹ | 668
3619 Atsi | ŋ j a p ²¹ | 686
3621 Lashi | ŋ j a p ³¹ + ts ei ⁵⁵ | 686 3310
3623 ProtoBurmish | ŋ j a t ⁴ | 686
4030 OldBurmese | ṅ/ŋ ai | 668
"""


@pytest.fixture(scope="module")
def burmish(spark):
    rows = {0: ["doculect", "concept", "tokens", "cogids"]}
    for line in BURMISH.strip().split("\n"):
        head, tokens, ids = line.split(" | ")
        number, doculect = head.split()
        rows[int(number)] = [doculect, "", tokens, [int(x) for x in ids.split()]]
    return morphemes(wordlist_from_rows(spark, rows), "cogids").persist()


LANGUAGES = ["Atsi", "Lashi", "OldBurmese"]


@pytest.mark.parametrize("tree", ["upgma", "nj"])
def test_sounds_of_one_kind_share_a_column(burmish, tree):
    rows = {}
    for r in reconstruct.align_sets(burmish, ["cogid"], tree).collect():
        rows.setdefault(r.cogid, {})[r.doculect] = r.alignment
    assert rows[665] == {"Atsi": ["ŋ", "o", "⁵¹"], "Lashi": ["ŋ", "o", "³¹"], "OldBurmese": ["ŋ", "a", "-"], "ProtoBurmish": ["ŋ", "a", "¹"]}
    assert rows[666]["Lashi"] == ["ŋ", "-", "³³"] and rows[666]["OldBurmese"] == ["ŋ", "a", "⁵"]
    for by in rows.values():
        for column in zip(*by.values()):
            assert len({P.sound_class(x) == "1" for x in column if x != "-"}) <= 1  # tones stand with tones


@pytest.mark.parametrize("features", [{}, {"position": True, "prosodic": True, "startend": True, "firstlast": True}])
def test_a_word_of_the_source_language(burmish, features):
    found = {r.cogid: list(r.word) for r in reconstruct.reconstruct(burmish, LANGUAGES, "ProtoBurmish", **features).collect()}
    assert found[665] == ["ŋ", "a", "¹"]


def test_a_word_of_the_source_language_from_one_hot_rows(burmish):
    from pyspark.ml.classification import DecisionTreeClassifier

    tree = reconstruct.Estimator(lambda: DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=1), True)
    found = {r.cogid: list(r.word) for r in reconstruct.reconstruct(burmish, LANGUAGES, "ProtoBurmish", tree).collect()}
    assert found[665] == ["ŋ", "a", "¹"]


def test_votes_on_a_word_of_the_source_language(burmish):
    votes = {(r.cogid, r.pos): r.percentiles for r in reconstruct.fuzzy_reconstruct(burmish, LANGUAGES, "ProtoBurmish").collect()}
    assert votes[665, 0] == "ŋ:100" and votes[665, 1] == "a:100"


SOUNDS = "p t k b d ts s x ʔ n m ŋ l r j w a i u e o ə ai ⁵¹ ²¹ + _ 'b/b ṅ/ŋ ʃ ʒ tʰ dʒ aː ĕ ũ".split()


def test_classes():
    assert [P.sound_class(x) for x in "tsʰ ĕ ³³ u̱ ui aːu kʰ ʃ ʒ ɬ 'w/w dʒ _ - ʔ ç".split()] == list("CE1UUAKSSLWC_0HS")
    for x in SOUNDS:
        assert P.similarity(x, x) == 1.0
        for y in SOUNDS:
            assert P.similarity(x, y) == P.similarity(y, x) <= 1.0
    assert P.similarity("p", "b") > P.similarity("p", "f") > P.similarity("p", "s") and P.similarity("k", "tʃ") > P.similarity("k", "t")
    assert P.similarity("u", "w") > P.similarity("u", "t") > P.similarity("u", "⁵¹")


def test_profile_as_in_column_expressions(spark):
    rng = random.Random(7)
    words = [[rng.choice(SOUNDS) for _ in range(rng.randint(1, 8))] for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "tokens array<string>")
    got = df.select("tokens", F.array_join(prosody(F.col("tokens"), "ps"), "").alias("p"), F.transform("tokens", sonority_of).alias("s")).collect()
    for r in got:
        assert P.profile(r.tokens) == r.p and [P.sonority(x) for x in r.tokens] == list(r.s)


@pytest.mark.parametrize("mode", ["global", "overlap"])
@pytest.mark.parametrize("extend", [0.5, 1.0])
def test_many_pairs_at_once(mode, extend):
    """The same alignments as one by one, and no better score among all alignments of short words."""
    rng = random.Random(3)
    words = [[rng.choice(SOUNDS) for _ in range(rng.randint(0, 6))] for _ in range(600)]
    a, b = words[:300], words[300:]
    totals, columns = P.align_pairs(a, b, -1.0, extend, mode, columns=True)
    for x, y, total, way in zip(a, b, totals, columns):
        left, right, score = P.align(x, y, -1.0, extend, mode)
        assert abs(total - score) < 1e-9 and [c[0][0] for c in way] == left and [c[1][0] for c in way] == right
    for x, y in zip(a[:60], b[:60]):
        if len(x) < 4 and len(y) < 4:
            assert abs(P.align(x, y, -1.0, extend, mode)[2] - best_of_all(x, y, extend, mode)) < 1e-9


def best_of_all(a, b, extend, mode):
    """The greatest score over all alignments."""
    u, v = list(zip(a, P.profile(a))), list(zip(b, P.profile(b)))

    def rest(i, j, last):
        if i == len(u) and j == len(v):
            return 0.0
        ways = []
        if i < len(u) and j < len(v):
            ways.append(P.alike(u[i], v[j]) + rest(i + 1, j + 1, 0))
        for state, more, x, at, end in ((1, i < len(u), u[i] if i < len(u) else None, j, len(v)), (2, j < len(v), v[j] if j < len(v) else None, i, len(u))):
            if more:
                price = 0.0 if mode == "overlap" and at in (0, end) else -P.WEIGHTS[x[1]] * (extend if last == state else 1)
                ways.append(price + rest(i + (state == 1), j + (state == 2), state))
        return max(ways)

    return rest(0, 0, 0)


def test_distances():
    far = P.distances([["p", "a", "t"], ["p", "a", "t"], [], [], ["p", "a", "t"]], [["p", "a", "t"], ["b", "a", "d"], [], ["a"], ["k", "i", "s", "o"]])
    assert far[0] == far[2] == 0 and 0 < far[1] < 0.3 and far[3] == 1 and far[4] > 0.7


@pytest.mark.parametrize("tree", ["upgma", "nj"])
def test_progressive_alignment(tree):
    rng = random.Random(5)
    for _ in range(20):
        words = [[rng.choice(SOUNDS) for _ in range(rng.randint(0, 6))] for _ in range(rng.randint(1, 7))]
        rows = P.align_many(words, tree=tree)
        assert len({len(r) for r in rows}) == 1 and [[x for x in r if x != "-"] for r in rows] == words
        assert all(any(x != "-" for x in c) for c in zip(*rows))
    assert P.align_many([]) == []


def test_guide_trees():
    """Distances along a tree in which the two closest items aren't neighbours: neighbour joining finds these, averages don't."""
    # ((a:1, b:4):1, c:1, d:1) as distances between its ends
    far = np.array([[0, 5, 3, 3], [5, 0, 6, 6], [3, 6, 0, 2], [3, 6, 2, 0]], float)
    assert P.guide_tree(far, "nj")[0] in ((0, 1), (2, 3)) and P.guide_tree(far, "upgma")[:2] == [(2, 3), (0, 2)]
    with pytest.raises(ValueError):
        P.guide_tree(far, "other")
