"""Registered queries against their SQL, and the stages of the pipeline one after the other."""

from __future__ import annotations

import duckdb
import pytest
from wattcell.llm.queries import ORACLES, QUERIES

import corpus_pipeline

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    rows = want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False, name=None)
    assert got == sorted(repr(r) for r in rows)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        last = k == len(corpus_pipeline.STAGES) - 1
        assert docs.columns == ([*columns, "copy"] if last else columns)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0.6 * counts[0]
    assert corpus_pipeline.run(spark, SF).count() == counts[5]
