"""The leave-out experiment: all runs in one job against each run by itself."""

import math

import pytest
from pyspark.sql import functions as F

from lexispark.operators import clusters as K
from lexispark.operators import metrics as M
from lexispark.operators import sites as S
from lexispark.operators.prepare import shrink_alignments
from lexispark.plans import experiments as E
from lexispark.plans.derived import LANGS, morphemes


@pytest.fixture(scope="module")
def words(spark, sf_dir):
    return morphemes(spark, sf_dir).where("cogid % 5 = 0").checkpoint()


def one_run(words, run):
    """What is out, what is found from the rest, and the accuracy, of one run."""
    each = words.withColumn("out", F.pmod(F.xxhash64(F.lit(0), F.lit(run), "id", "cogid"), F.lit(1 << 30)) < int(0.25 * (1 << 30)))
    rest = each.where("not out").drop("out")
    cells = rest.select("cogid", F.posexplode("alignment").alias("pos", "x")).groupBy("cogid", "pos").agg(F.max(F.col("x") != "-").alias("used")).where("used")
    used = cells.groupBy("cogid").agg(F.array_sort(F.collect_list("pos")).alias("used"))
    gold = each.where("out").join(used, "cogid").select("cogid", "doculect", F.transform("used", lambda p: F.get("alignment", p)).alias("alignment"))
    found = E.correspondence_patterns(shrink_alignments(rest, ["cogid"]), LANGS, 2)
    return each, rest, found, M.hit_rate(K.predict_words(found, LANGS, 1), gold)


def test_runs_in_one_job(spark, words):
    got = {(r.run, r.doculect): (round(r.accuracy, 9), r.words) for r in E.leave_out(words, LANGS, runs=2).collect()}
    rows = {r.run: r for r in E.leave_out_summary(words, LANGS, runs=2).collect()}
    assert set(rows) == {0, 1}
    for run in (0, 1):
        each, rest, found, rate = one_run(words, run)
        assert {k: v for k, v in got.items() if k[0] == run} == {(run, r.doculect): (round(r.accuracy, 9), r.words) for r in rate.collect()}
        row, summary = rows[run], M.dataset_summary(found).first()
        assert (row.removed, row.sites, row.clusters) == (each.where("out").count(), summary.sites, summary.patterns)
        for name, value in (("density", S.density(rest)), ("fuzziness", K.fuzziness(found)), ("site_score", K.mean_site_score(found, found)), ("purity", K.purity(found)), ("upper_bound", S.upper_bound(found))):
            assert math.isclose(row[name], value.first()[0], rel_tol=1e-9), name


def test_subset(spark, words):
    few = E.leave_out_summary(words, LANGS, runs=1, subset=0.5).first()
    every = E.leave_out_summary(words, LANGS, runs=1).first()
    assert 0 < few.removed < every.removed and 0 < few.sites < every.sites


def test_report_compares_patterns_once(spark, sf_dir, monkeypatch):
    """One, two and three best sounds come from one comparison of the patterns."""
    compared, real = [], K.sounds_of_fitting
    monkeypatch.setattr(K, "sounds_of_fitting", lambda *a, **k: compared.append(1) or real(*a, **k))
    E.prediction_report(morphemes(spark, sf_dir).where("cogid <= 40"), LANGS)
    assert len(compared) == 1
