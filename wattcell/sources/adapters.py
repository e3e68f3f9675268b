"""The driver's test tables read as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# 2024-01-01 was a Monday.
_A_MONDAY = "2024-01-01"


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as 5G telemetry with measured deep sleep."""
    load = F.col("value") % 100
    user = F.col("user_id")
    asleep = (load < 25) & (F.col("event_id") % 5 != 0)
    return events_table(spark, sf_dir).select(
        F.concat(F.lit("B_"), (user % 25).cast("string")).alias("bs"),
        F.concat(F.lit("C_"), (user % 6).cast("string")).alias("cell"),
        F.col("event_id").alias("seq"),
        "ts",
        load.alias("prb"),
        (F.col("value") * 1000).alias("traffic_kb"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("users"),
        (F.lit(80) + user % 20).cast("double").alias("bbu_w"),
        (F.lit(100.0) + load * 2).alias("rru_w"),
        F.when(asleep, (F.col("event_id") * 37 % 2000 * 1000).cast("double")).otherwise(0.0).alias("ds_ms"),
    )


def events_4g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_telemetry(spark, sf_dir).drop("ds_ms")


def is_weekday(ts="ts"):
    return F.pmod(F.datediff(F.to_date(ts), F.lit(_A_MONDAY).cast("date")), F.lit(7)) < 5


def lineitem_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as telemetry, the larger table: ten stations of three cells.

    Several lines share an order and line number, so ``seq`` packs further columns.
    """
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return table.select(
        F.concat(F.lit("B_"), (F.col("l_suppkey") % 10).cast("string")).alias("bs"),
        F.concat(F.lit("C_"), (F.col("l_linenumber") % 3).cast("string")).alias("cell"),
        "l_shipdate",
        (F.col("l_partkey") % 48).cast("int").alias("tod_bin"),
        (F.col("l_quantity") * 2).alias("prb"),
        F.col("l_extendedprice").alias("traffic_kb"),
        (F.lit(100.0) + F.col("l_quantity")).alias("rru_w"),
    )
