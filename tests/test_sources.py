import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from wattcell import schema
from wattcell.operators.prepare import add_time, any_sleep, has_ground_truth, prepare
from wattcell.sources import sinks, telemetry


def test_header_cleanup(spark, tmp_path):
    header = "﻿Base  Station ID,Cell\xa0ID,Timestamp ,PRB Usage Ratio (%),Traffic Volume (KByte),Number of Users,BBU Energy (W),RRU Energy (W),Deep Sleep Time (Millisecond),Extra  one"
    lines = ["b1,c1,00:30,abc,2048,3,80,100,900000,x", "b1,c1,01:00,,NaN,3,80,100,,y", "b1,c1,25:00,5,1,1,1,1,0,z"]
    path = tmp_path / "t.csv"
    path.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    df = telemetry.load_prepared(spark, str(path))
    assert {"bs", "cell", "prb", "Extra one"} <= set(df.columns)
    got = df.orderBy("seq").collect()
    assert len(got) == 2  # 25:00 is no time of day
    assert got[0].prb is None and got[1].prb is None and got[1].traffic_kb is None
    assert (got[0].tod_bin, got[0].traffic_mb, got[0].sleep_frac) == (1, 2.0, 0.5)
    assert got[1].sleep_frac is None and got[1].sleep_on is False


def test_names_and_validation(spark):
    df = rows(spark, [1.0])
    long_names = schema.with_headers(df)
    assert schema.resolve(long_names, "prb") == "PRB Usage Ratio (%)"
    assert schema.canonicalize(long_names).columns == df.columns
    info = schema.validate(df, schema.REQUIRED_KEYS, ["seq"], count_rows=True)
    assert info["n_rows"] == 1 and info["resolved_keys"]["bs"] == "bs"
    with pytest.raises(ValueError, match="missing required"):
        schema.validate(df.drop("prb"), schema.REQUIRED_KEYS, ["nothing"])
    with pytest.raises(KeyError):
        schema.resolve(df, "unknown")
    with pytest.raises(KeyError):
        schema.resolve(df.drop("prb"), "prb")


def test_repair_suffixes(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, 3.0)], "prb_x double, prb_y double")
    assert sorted(r.prb for r in schema.repair_suffixes(df).collect()) == [1.0, 2.0]
    assert schema.repair_suffixes(df.drop("prb_y")).columns == ["prb"]
    assert schema.ensure_threshold_columns(df).columns[-2:] == ["p30", "p70"]


def test_clock_text(spark):
    texts = ["09:30", "9:30", "9:30:00", "24:00", "23:59:59", "2024-01-01", "07:5", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "ts string, seq long")
    got = {r.seq: (r.tod_bin, r.time_of_day) for r in add_time(df).collect()}
    assert got == {0: (19, "09:30"), 1: (19, "09:30"), 4: (47, "23:30"), 6: (14, "07:00")}


def test_sleep_cap(spark):
    df = rows(spark, [1.0] * 5).withColumn(
        "ds_ms", F.element_at(F.array(*[F.lit(x).cast("double") for x in (-5, 0, 900000, 2000000, None)]), (F.col("seq") + 1).cast("int"))
    )
    got = prepare(df).orderBy("seq").collect()
    assert [r.sleep_on for r in got] == [False, False, True, True, False]
    assert [r.sleep_frac for r in got] == [0.0, 0.0, 0.5, 1.0, None]


def test_four_g(spark):
    df = rows(spark, [1.0, 2.0]).drop("ds_ms")
    assert not has_ground_truth(df)
    got = prepare(df)
    assert any_sleep(got).first().any_sleep is False
    assert {r.sleep_frac for r in got.collect()} == {0.0}


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        telemetry.read_telemetry(spark, "/nowhere/x.csv")


def test_materialized_copy_and_thresholds(spark, tmp_path):
    path = str(tmp_path / "weekday.csv")
    sinks.write_csv(schema.with_headers(rows(spark, [float(i) for i in range(60)]).drop("seq")).coalesce(1), path)
    copy = telemetry.ensure_parquet(spark, path)
    assert copy == str(tmp_path / "_cache" / "weekday.parquet")
    df = telemetry.load_prepared(spark, copy)
    assert df.count() == 60 and "seq" in df.columns
    out = telemetry.thresholds_path(path, "Global")
    telemetry.ensure_thresholds(df, "Global", out)
    assert telemetry.read_thresholds(spark, out).count() == 48
    with pytest.raises(ValueError):
        telemetry.load_prepared(spark, _without_sleep(spark, tmp_path))


def _without_sleep(spark, tmp_path):
    path = str(tmp_path / "four.parquet")
    rows(spark, [1.0]).drop("ds_ms").write.parquet(path)
    assert telemetry.load_prepared(spark, path, require_sleep=False).count() == 1
    return path


def _in_files(spark, path, sizes, write):
    """Consecutive rows of one cell in a file for each of ``sizes``; ``prb`` is the place of the row."""
    start = 0
    for k, size in enumerate(sizes):
        part = schema.with_headers(rows(spark, [float(start + i) for i in range(size)]).drop("seq"))
        write(part.coalesce(1).sortWithinPartitions("PRB Usage Ratio (%)").write.mode("append"), f"{path}/part={k}")
        start += size


@pytest.mark.parametrize("limit", ["128m", "2k"])
def test_order_over_several_files(spark, tmp_path, limit):
    sizes = [3, 400, 1, 90]
    csv, parquet = str(tmp_path / "t.csv"), str(tmp_path / "t.parquet")
    _in_files(spark, csv, sizes, lambda w, p: w.option("header", True).csv(p))
    _in_files(spark, parquet, sizes, lambda w, p: w.parquet(p))
    settings = {"spark.sql.files.maxPartitionBytes": limit, "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for path in (csv, parquet):
            df = telemetry.read_telemetry(spark, path)
            assert "part" in df.columns and not [c for c in df.columns if c.startswith("_")]
            assert [(r.seq, r.prb) for r in df.orderBy("seq").collect()] == [(i, float(i)) for i in range(sum(sizes))]
            bins = [i % 48 for size in sizes for i in range(size)]  # every file starts at midnight
            falls = [b < a for a, b in zip(bins, bins[1:])]
            days = telemetry.load_prepared(spark, path, day_mode="sequence").orderBy("seq").collect()
            assert [r.tod_bin for r in days] == bins
            assert [r.day_index for r in days] == [sum(falls[:i]) for i in range(len(bins))]
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_filters_reach_the_scan_without_stored_order(spark, tmp_path, capsys):
    path = str(tmp_path / "t.parquet")
    rows(spark, [1.0, 2.0, 3.0]).drop("seq").write.parquet(path)
    df = telemetry.read_telemetry(spark, path).where("bs = 'b'").select("seq", "prb")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(bs,b)" in plan
    assert "ReadSchema: struct<bs:string,prb:double" in plan
    assert sorted((r.seq, r.prb) for r in df.collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_reports(spark, tmp_path):
    report = {"a": 1, "b": {"c": [1.5, None], "d": (1, 2)}}
    path = sinks.write_report(spark, report, str(tmp_path / "r"))
    assert sinks.read_report(spark, path) == json.loads(json.dumps(report))
    df = spark.range(3).select("id", F.struct("id").alias("s"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert len(sinks.report_rows(df)) == 3
    with pytest.raises(ValueError):
        sinks.report_rows(spark.range(sinks.MAX_REPORT_ROWS + 1))
