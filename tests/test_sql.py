"""The functions for Spark SQL give what the operators give."""

import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import sql
from lexispark.functions.sequences import GAP, MISSING
from lexispark.operators import reconstruct, sites, trimming
from lexispark.sources.wordlists import load_wordlist, wordlist_from_rows


@pytest.fixture(scope="module")
def patterns(spark):
    sql.register(spark)
    rng = random.Random(3)
    rows = [(k % 40, rng.choice("cv"), [rng.choice(["a", "b", GAP, MISSING, MISSING, MISSING]) for _ in range(4)]) for k in range(150)]
    frame = spark.createDataFrame(rows, "g int, struct string, pattern array<string>")
    frame.createOrReplaceTempView("patterns")
    return frame.persist()


@pytest.mark.parametrize("mode", ["ranked", "pairs", "squared", "coverage"])
def test_scores(spark, patterns, mode):
    found = spark.sql(f"select g, score_patterns(collect_list(pattern), '{mode}') as score from patterns group by g")
    want = {r.g: r.score for r in sites.score_patterns(patterns, ["g"], mode).collect()}
    got = {r.g: r.score for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - (want[g] or 0)) < 1e-9 or (got[g] is None and want[g] is None) for g in got)


def test_consensus(spark, patterns):
    found = spark.sql("select g, consensus_pattern(p) as c, incompatible_columns(p) as i from (select g, collect_list(pattern) as p from patterns group by g)")
    want = {r.g: (r.consensus, r.conflicts) for r in sites.consensus(patterns, ["g"]).collect()}
    assert {r.g: (r.c, r.i) for r in found.collect()} == want and any(c for c, _ in want.values()) and any(c is None for c, _ in want.values())


def test_pairs(spark, patterns):
    kinds = patterns.select("struct", "pattern").distinct()
    kinds.createOrReplaceTempView("kinds")
    found = spark.sql("select a.struct, a.pattern as p, b.pattern as q, pattern_matches(a.pattern, b.pattern) as n from kinds a join kinds b on a.struct = b.struct where patterns_fit(a.pattern, b.pattern)")
    want = sites.compatible_pairs(kinds.withColumnRenamed("pattern", "l_pattern"), kinds.withColumnRenamed("pattern", "r_pattern"))
    row = lambda r: (r[0], tuple(r[1]), tuple(r[2]), r[3])
    assert sorted(map(row, found.collect())) == sorted(map(row, want.select("struct", "l_pattern", "r_pattern", "matches").collect()))


def test_kinds_of_wordlists(spark, tmp_path):
    rows = {0: ["doculect", "concept", "tokens", "cogid"], 1: ["a", "x", "p a", 1]}
    frame = wordlist_from_rows(spark, rows)
    (tmp_path / "w.tsv").write_text("ID\tDOCULECT\tCONCEPT\tTOKENS\tCOGID\n1\ta\tx\tp a\t1\n")
    for source in (rows, frame, str(tmp_path / "w.tsv")):
        assert [tuple(r) for r in load_wordlist(spark, source).select("id", "doculect", "tokens", "cogid").collect()] == [(1, "a", ["p", "a"], 1)]
    with pytest.raises(ValueError):
        load_wordlist(spark, 1)


def test_random_trimming_can_be_lenient(spark):
    rows = [r.split() if " " in r else list(r) for r in ["bbabb", "bb-bb", "-b-b-", "-b-b-"]]
    frame = spark.createDataFrame([(1, i, f"L{i}", r) for i, r in enumerate(rows)], "cogid long, id long, doculect string, alignment array<string>")
    width = lambda strict: len(trimming.trim_random(frame, 1, strict=strict).first().alignment)
    assert (width(True), width(False)) == (5, 3)


def test_an_aligner_can_be_given(spark):
    pairs = spark.createDataFrame([(["t", "a"], ["a"]), (["a", "t"], ["t"])], "predicted array<string>, attested array<string>")
    ends = lambda a, b: (a, ["-"] * (len(a) - len(b)) + b)
    starts = lambda a, b: (a, b + ["-"] * (len(a) - len(b)))
    assert reconstruct.bcubed_f(pairs, aligner=ends).first().f == reconstruct.bcubed_f(pairs).first().f
    assert F is not None and reconstruct.bcubed_f(pairs, aligner=starts).first().f <= 1
