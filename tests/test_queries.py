"""Registered queries at the smallest scale, against their SQL where there is any."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans import queries
from lexispark.plans.derived import morphemes
from lexispark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in values)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert rows(got) == rows(duck.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_folder(tmp_path):
    """The rest imports and registers its queries where the llm folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lexispark", tmp_path / "lexispark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_every_set_is_reconstructed(spark, sf_dir, monkeypatch):
    """Sets whose words equal another's get their word too, and count as often as they stand when words are drawn."""
    rows = morphemes(spark, sf_dir)
    few = rows.where("cogid <= 12")
    both = few.unionByName(few.withColumn("cogid", few["cogid"] + 1000).withColumn("id", few["id"] + 100_000)).checkpoint()
    monkeypatch.setattr(queries, "morphemes", lambda *_: both)
    sets = {r.cogid for r in both.where("doculect <> 'L0'").select("cogid").distinct().collect()}
    found = {r.cogid: r.word for r in QUERIES["reconstructed_words"](spark, sf_dir).collect()}
    assert set(found) == sets and all(found[c] == found[c + 1000] for c in sets if c < 1000)
    for name in ("fuzzy_reconstructions", "reconstructions_by_split"):
        assert {r.cogid for r in QUERIES[name](spark, sf_dir).select("cogid").distinct().collect()} == sets
