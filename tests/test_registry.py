"""Every registered query with SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def _comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    want, columns = found.fetchall(), [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == {d[0]: str(d[1]) for d in found.description}
    assert _comparable([tuple(r) for r in df.collect()], df.columns) == _comparable(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 15


def test_every_query_is_checked_or_fits_a_model():
    text = {name for name in entry.queries() if name.startswith("op") and name[2:3].isdigit()} | {"pipeline"}
    unchecked = set(entry.queries()) - set(entry.oracle_sql()) - text
    assert unchecked == {
        "train_eval", "train_eval_logistic", "station_holdout", "ablation", "model_policy", "transfer_profile", "model_calibration",
    }
