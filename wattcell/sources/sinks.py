"""Writing result tables and reports."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

MAX_REPORT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A report table (usually one row with nested columns) as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (set, tuple)):
        return list(value)
    return str(value)


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    """A nested driver-side report as a one-row table of text, ready to be written."""
    return spark.createDataFrame([(json.dumps(report, default=_plain),)], "value string")


def write_report(spark: SparkSession, report: dict, path: str, mode: str = "overwrite") -> str:
    """A nested driver-side report as one JSON document in ``path``."""
    report_frame(spark, report).write.mode(mode).text(path)
    return path


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()["value"])


def report_rows(df: DataFrame) -> list[dict]:
    """Rows of a small report table for a nested report; larger tables are refused."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"report table has more than {MAX_REPORT_ROWS} rows; write it as a table")
    return [row.asDict(recursive=True) for row in rows]
