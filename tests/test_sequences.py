"""Column expressions over sound sequences, row by row against worked values (fixed values: inputs and results)."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import sequences as S
from lexispark.functions.phonology import prosody, sound_class, structure
from lexispark.operators.prepare import gap_free_pairwise


def arr(text):
    return F.array(*[F.lit(x) for x in text.split()])


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("sound, clean", [("a/b", "b"), ("a", "a"), ("a/b.c/d", "b.d"), ("a/b/c", "b"), ("", "")])
def test_clean_sound(spark, sound, clean):
    assert value(spark, S.clean_sound(F.lit(sound))) == clean


def test_unjoin_and_tokens(spark):
    assert value(spark, S.unjoin(arr("k.p a"))) == ["k", "p", "a"]
    assert value(spark, S.alignment_to_tokens(arr("k.p - a/b"))) == ["k", "p", "b"]


def test_matches_and_mismatches(spark):
    a, b = arr("a - Ø b c"), arr("a - x Ø d")
    assert value(spark, S.matches(a, b)) == 1
    assert value(spark, S.mismatches(a, b)) == 1
    assert value(spark, S.merge_patterns(a, b)) == ["a", "-", "x", "b", "c"]


@pytest.mark.parametrize("source, target, holds", [("C V", "C C V", True), ("V C", "C C V", False), ("C", "V", False), ("C V C", "C V C", True)])
def test_subsequence(spark, source, target, holds):
    assert value(spark, S.is_subsequence(arr(source), arr(target))) is holds


def test_bleu(spark):
    word, reference = arr("this is a test"), arr("this is a small test")
    assert round(value(spark, S.bleu(word, reference, 2, [0.5, 0.5])), 2) == 0.64
    assert round(value(spark, S.bleu(word, reference, 2, [0.5, 0.5], trim=False)), 2) == 0.70
    assert round(value(spark, S.bleu(word, reference, 2, trim=False)), 2) == 0.70
    assert value(spark, S.bleu(F.expr("cast(array() as array<string>)"), reference)) is None


def test_template(spark):
    assert value(spark, S.align_to_template(arr("k a"), arr("C v"), "Cvc")) == ["k", "a", "-"]
    for tokens, kinds, template in (("k a", "c", "Cvc"), ("k a", "c v", "Cv"), ("k a p", "C v c", "Cv")):
        with pytest.raises(Exception, match="fit the template"):
            value(spark, S.align_to_template(arr(tokens), arr(kinds), template))


def test_shrink(spark):
    rules = {"i m": "I", "i": "I", "n c": "R", "n": "R", "c": "R"}
    made = value(spark, S.shrink(arr("b o k"), arr("i n c"), rules))
    assert (made["tokens"], made["structure"]) == (["b", "ok"], ["I", "R"])
    made = value(spark, S.shrink(arr("b w a k"), arr("i m n c"), rules))
    assert (made["tokens"], made["structure"]) == (["bw", "ak"], ["I", "R"])
    made = value(spark, S.shrink(arr("b au"), arr("i n"), rules))
    assert (made["tokens"], made["structure"]) == (["b", "au"], ["I", "R"])
    made = value(spark, S.shrink(arr("a"), arr("n"), rules))
    assert (made["tokens"], made["structure"]) == (["a"], ["R"])


def test_gap_free_pairwise(spark):
    def left(a, b, syllables=None):
        return value(spark, gap_free_pairwise(arr(" ".join(a)), arr(" ".join(b)), syllables))["a"]

    assert left("andra", "an-ra")[1] == "n<d"
    assert left("andra", "an-ra", [0, 2])[2] == "d>r"
    assert left("este", "-ste")[0] == "e>s"
    assert left("euste", "--ste")[0] == "e>u>s"


def test_classes(spark):
    assert value(spark, F.transform(arr("p a ¹ + - ù/u 'b/b"), sound_class)) == ["C", "V", "T", "+", "0", "V", "C"]
    assert value(spark, structure(arr("p l a ¹"), "cv")) == ["c", "c", "v", "t"]
    assert value(spark, structure(arr("p l a ¹"), "c")) == ["c"] * 4
    assert value(spark, prosody(arr("p l a t"))) == ["C", "C", "V", "c"]
    with pytest.raises(ValueError):
        structure(arr("a"), "none")
    assert value(spark, S.spread_classes(arr("c v"), arr("p - a"))) == ["c", "-", "v"]


def test_sonority_is_looked_up_once(spark):
    """Letters of a long word come from one pass over its sounds, also where they are laid out over an alignment."""
    import time

    n, begun = 300, time.time()
    tokens = F.array(*[F.lit(x) for x in "spa" * (n // 3)])
    laid = value(spark, S.spread_classes(prosody(F.transform(tokens, lambda x: x)), F.concat(F.array(F.lit("-")), tokens)))
    assert laid == ["-", *"CCV", *"cCV" * (n // 3 - 1)]
    assert time.time() - begun < 60
    plan = spark.range(1).select(prosody(F.split("id", "")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1


def test_template_computes_sounds_and_classes_once(spark):
    made = S.align_to_template(F.split("t", " "), F.split(F.upper("k"), " "), "cvc")
    rows = spark.createDataFrame([("p a", "c v"), ("a t", "v c")], "t string, k string")
    plan = rows.select(made.alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(t") == 1 and plan.count("upper(k") == 1
    lower = S.align_to_template(F.split("t", " "), F.split("k", " "), "cvc")
    assert [r.a for r in rows.select(lower.alias("a")).collect()] == [["p", "a", "-"], ["-", "a", "t"]]
