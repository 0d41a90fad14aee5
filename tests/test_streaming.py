"""Sites kept up over a stream equal those of all words at once."""

from pyspark.sql import functions as F

from lexispark.operators.sites import get_sites
from lexispark.plans.derived import LANGS, morphemes
from lexispark.streaming.words import follow_words, latest_sites


def test_stream_of_words(spark, sf_dir, tmp_path):
    words = morphemes(spark, sf_dir).where("cogid < 40").cache()
    source, paths = tmp_path / "in", [str(tmp_path / x) for x in ("words", "sites", "state")]
    for k in range(2):
        words.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(words.schema).parquet(str(source))
        follow_words(stream, *paths, LANGS, 2).awaitTermination()
    got = sorted(str(r) for r in latest_sites(spark, paths[1]).select("cogid", "pos", "struct", "pattern").collect())
    assert got == sorted(str(r) for r in get_sites(words, LANGS, 2).select("cogid", "pos", "struct", "pattern").collect())
