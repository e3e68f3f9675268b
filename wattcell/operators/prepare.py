"""Derived columns of a telemetry table: time, units, sleep labels, lags and days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattcell.functions import columns as fx
from wattcell.operators.ordered import HOT, HOT_CELL_ROWS, Running, mark_hot_cells, running_per_cell
from wattcell.schema import CELL, require_columns
from wattcell.session import materialize

DAY_MODES = ("date", "sequence", "reference")
# Order of the intervals of a cell once the day is known, and the matching time slot.
SERIES_ORDER = ["day_index", "tod_bin", "seq"]
DAY_KEYS = [*CELL, "day_index"]


def series_slot():
    return F.col("day_index") * 48 + F.col("tod_bin")


def _is_timestamp(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def add_time(df: DataFrame) -> DataFrame:
    """Hour, minute, half-hour bin and label; rows without a readable time are dropped."""
    if _is_timestamp(df, "ts"):
        hour, minute = F.hour("ts"), F.minute("ts")
    else:
        hour, minute = fx.clock_part(F.col("ts"), 1), fx.clock_part(F.col("ts"), 2)
    timed = df.withColumns({"hour": hour, "minute": minute}).filter("hour is not null and minute is not null")
    binned = timed.withColumn("tod_bin", fx.half_hour_bin(F.col("hour"), F.col("minute")))
    return binned.withColumn("time_of_day", fx.time_label(F.col("tod_bin")))


def add_units_and_labels(df: DataFrame) -> DataFrame:
    """Traffic in MB and, where deep-sleep time is measured, the sleep labels."""
    added = {}
    if "traffic_kb" in df.columns:
        added["traffic_mb"] = fx.kb_to_mb(F.col("traffic_kb"))
    if "ds_ms" in df.columns:
        seconds = F.col("ds_ms") / 1000.0
        added |= {
            "deep_sleep_s": seconds,
            "sleep_on": fx.sleeping(seconds),
            "sleep_frac": fx.sleep_fraction(seconds),
        }
    else:
        added |= {"sleep_on": F.lit(False), "sleep_frac": F.lit(0.0)}
    return df.withColumns(added)


def add_lags_and_day(df: DataFrame, day_mode: str | None = None) -> DataFrame:
    """Previous traffic and users of the same cell, and the number of the day.

    ``date``       days are the distinct calendar dates of a cell, numbered from 0;
    ``sequence``   a new day starts when the time of day falls back in arrival order;
    ``reference``  time of day only, every row is day 0 (and lags run across days).
    """
    if day_mode is None:
        day_mode = "date" if _is_timestamp(df, "ts") else "reference"
    if day_mode not in DAY_MODES:
        raise ValueError(f"unknown day mode {day_mode!r}; use one of {DAY_MODES}")

    minute_of_day = F.col("hour") * 60 + F.col("minute")
    if day_mode == "date":
        df = df.withColumns({"_date": F.to_date("ts"), "_minute": minute_of_day})
        order, slot = ["_date", "_minute", "seq"], F.unix_date("_date") * 1440 + F.col("_minute")
        marker = "_date"
    elif day_mode == "reference":
        df = df.withColumn("_minute", minute_of_day)
        order, slot, marker = ["_minute", "seq"], F.col("_minute"), None
    else:
        order, slot, marker = ["seq"], F.lit(0), "tod_bin"

    before = [Running(f"prev_{c}", F.col(c), "prev") for c in ("traffic_mb", "users") if c in df.columns]
    if marker:
        before.append(Running("_before", F.col(marker), "prev"))
    if before:
        df = running_per_cell(df, CELL, order, before, slot)
    if marker is None:
        df = df.withColumn("day_index", F.lit(0))
    else:
        changed = F.col("_date") != F.col("_before") if day_mode == "date" else F.col("tod_bin") < F.col("_before")
        step = F.when(changed, 1).otherwise(0)
        df = running_per_cell(df, CELL, order, [Running("day_index", step, "sum")], slot)
        df = df.withColumn("day_index", F.col("day_index").cast("int"))
    return df.drop("_date", "_minute", "_before")


def prepare(df: DataFrame, day_mode: str | None = None, hot_cell_rows: int = HOT_CELL_ROWS) -> DataFrame:
    """All derived columns, from a table in the short column names with ``seq``.

    With hot cells the result is stored: the operators that follow would otherwise
    repeat the block-wise windows.
    """
    require_columns(df, ["bs", "cell", "ts", "seq"], "prepare")
    timed = add_units_and_labels(add_time(df))
    out = add_lags_and_day(mark_hot_cells(timed, hot_cell_rows), day_mode)
    return materialize(out, "prepared") if HOT in out.columns else out


def has_ground_truth(df: DataFrame) -> bool:
    """Whether the table measures deep sleep at all (raw column present)."""
    return "ds_ms" in df.columns


def any_sleep(df: DataFrame) -> DataFrame:
    """One row: whether any interval is labelled as sleeping."""
    return df.agg(F.coalesce(F.bool_or("sleep_on"), F.lit(False)).alias("any_sleep"))
