"""Wordlists read and written as a Spark data source."""

import io

import pytest
from pyspark.sql import functions as F

from lexispark.sources.datasource import WordlistSource, _lines
from lexispark.sources.wordlists import read_wordlist

TEXT = "ID\tDOCULECT\tCONCEPT\tTOKENS\tCOGIDS\n# a remark\n" + "".join(f"{i}\tL{i % 4}\tc{i % 7}\tŋ o ⁵¹ + {'a' * (i % 9)}\t{i} {i + 1}\n" for i in range(1, 300))


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(WordlistSource)
    return lambda path, **options: spark.read.format("wordlist").option("path", str(path)).options(**options).load()


def rows(df):
    return sorted(map(str, df.select("id", "doculect", "concept", "tokens", "cogids").collect()))


@pytest.mark.parametrize("part", [1000, 1 << 20])
def test_reading_by_ranges_of_bytes(spark, source, tmp_path, part):
    (tmp_path / "w.tsv").write_text(TEXT)
    found = source(tmp_path / "w.tsv", part=part)
    assert found.where("broken is not null").count() == 0 and (part > 10_000) == (found.rdd.getNumPartitions() == 1)
    assert rows(found) == rows(read_wordlist(spark, str(tmp_path / "w.tsv"))) and found.count() == 299


@pytest.mark.parametrize("end", ["", "\n", "last"])
def test_lines_of_ranges(end):
    """Each line belongs to one range, wherever ranges are cut."""
    text = ("a\n\nbcd\n" + "é" * 9 + "\nxy\r\n" + end).encode()
    whole = [x for x in text.decode().replace("\r", "").split("\n") if x]
    for part in range(1, len(text) + 1):
        assert [x for low in range(0, len(text), part) for x in _lines(io.BytesIO(text), low, min(low + part, len(text)))] == whole


def test_round_trip(spark, source, tmp_path):
    (tmp_path / "w.tsv").write_text(TEXT)
    words = source(tmp_path / "w.tsv", mode="failfast")
    out = f"{tmp_path}/out"
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        words.repartition(3).write.format("wordlist").option("path", out).mode(mode).save()
        back = source(out, mode="failfast")
        assert back.count() == 299 * times and rows(back.distinct()) == rows(words) and back.schema == words.schema
        assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_broken_rows(spark, source, tmp_path):
    (tmp_path / "w.tsv").write_text(TEXT + "x\tL1\tc\ta\t1\n7\tL1\n8\tL1\tc\ta\t1\tmore\n\n400\tL1\t\t\t\n")
    found = source(tmp_path / "w.tsv")
    assert sorted(r.broken.split(":")[0] for r in found.where("broken is not null").collect()) == ["2 cells under 5 names", "6 cells under 5 names", "invalid literal for int() with base 10"]
    last = found.where("id = 400").first()
    assert (last.concept, last.tokens, last.cogids) == (None, None, None)
    assert source(tmp_path / "w.tsv", mode="dropmalformed").count() == 300
    with pytest.raises(Exception, match="cells under|invalid literal"):
        source(tmp_path / "w.tsv", mode="failfast").agg(F.count("id")).collect()
    with pytest.raises(Exception, match="mode must be"):
        source(tmp_path / "w.tsv", mode="other")


def test_a_failed_write_leaves_nothing(spark, source, tmp_path):
    bad = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).cast("string").alias("doculect"))
    with pytest.raises(Exception, match="no"):
        bad.repartition(4).write.format("wordlist").option("path", f"{tmp_path}/out").mode("append").save()
    left = (tmp_path / "out")
    assert not left.exists() or not [p for p in left.iterdir() if p.name.startswith("part")]
