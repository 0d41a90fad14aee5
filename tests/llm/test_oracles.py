"""The queries of the llm operators at the smallest scale against their SQL."""

import duckdb
import pytest

from lexispark.llm.oracles import ORACLES
from lexispark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(str(tuple(r)) for r in found.select(*columns).collect())
    assert got == sorted(map(str, con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_result_for_each_document(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = QUERIES[name](spark, sf_dir)
    assert found.select("doc_id").distinct().count() == n
