"""Reading telemetry files and materializing tables from them."""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattcell.functions.columns import number
from wattcell.operators.ordered import HOT_CELL_ROWS
from wattcell.operators.prepare import prepare
from wattcell.operators.thresholds import threshold_table
from wattcell.schema import CELL, MEASURES, REQUIRED_KEYS, canonicalize, require_columns, validate


def _format_of(path: str) -> str:
    return "parquet" if path.rstrip("/").lower().endswith(".parquet") else "csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under the header's names; types are settled by :func:`typed`."""
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def typed(df: DataFrame) -> DataFrame:
    """Short names, text keys, numeric measures (NULL where unreadable), and ``seq``.

    ``seq`` is the arrival order. A table that stores it keeps it; else rows are
    numbered as they come (for files see :func:`numbered`).
    """
    df = canonicalize(df)
    casts = {c: F.col(c).cast("string") for c in CELL if c in df.columns}
    casts |= {c: number(F.col(c)) for c in MEASURES if c in df.columns}
    clock = df.schema["ts"].dataType if "ts" in df.columns else None
    if clock is not None and not isinstance(clock, (T.TimestampType, T.TimestampNTZType)):
        casts["ts"] = F.col("ts").cast("string")
    casts["seq"] = F.col("seq").cast("long") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.withColumns(casts)


def numbered(raw: DataFrame, fmt: str) -> DataFrame:
    """Adds ``seq``, the place of a row in its files: files in the order of their paths, rows as they stand in them.

    The order in which Spark packs files into tasks plays no part. A pass that reads no columns counts the rows of every
    file (Parquet) or split (CSV), and prefix sums of these counts give the number before each. Parquet rows know their
    place in the file, so filters still reach the scan. CSV rows are counted within their split, which
    one task reads from start to end; :func:`ensure_parquet` saves that pass for later runs.
    """
    place = {"_file": F.col("_metadata.file_path")}
    if fmt == "parquet":
        place |= {"_start": F.lit(0).cast("long"), "_row": F.col("_metadata.row_index")}
    else:
        place |= {"_start": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    splits = raw.select(*[c.alias(name) for name, c in place.items()]).groupBy("_file", "_start")
    splits = splits.agg(F.min("_row").alias("_least"), F.count("*").alias("_n"))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.sum("_n").over(earlier.orderBy("_file")).alias("_files_before"))  # one row a file
    within = F.sum("_n").over(earlier.partitionBy("_file").orderBy("_start"))
    before = F.coalesce("_files_before", F.lit(0)) + F.coalesce(within, F.lit(0)) - F.col("_least")
    starts = splits.join(files, "_file").select("_file", "_start", before.alias("_before"))
    rows = raw.withColumns(place).join(starts, ["_file", "_start"])
    return rows.withColumn("seq", F.col("_row") + F.col("_before")).drop("_file", "_start", "_row", "_before")


def read_telemetry(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Telemetry from CSV or Parquet, by extension unless ``fmt`` says otherwise."""
    fmt = fmt or _format_of(path)
    try:
        raw = spark.read.parquet(path) if fmt == "parquet" else read_csv(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    df = typed(raw if "seq" in canonicalize(raw).columns else numbered(raw, fmt))
    validate(df, REQUIRED_KEYS, where="read_telemetry")
    return df


def load_prepared(
    spark: SparkSession,
    path: str,
    require_sleep: bool = True,
    day_mode: str | None = None,
    hot_cell_rows: int = HOT_CELL_ROWS,
    fmt: str | None = None,
) -> DataFrame:
    """Telemetry with all derived columns; ``require_sleep`` demands measured deep sleep."""
    raw = read_telemetry(spark, path, fmt)
    df = prepare(raw, day_mode, hot_cell_rows)
    needed = ["tod_bin", "day_index"] + (["sleep_on", "sleep_frac"] if require_sleep else [])
    validate(df, REQUIRED_KEYS, needed, where="load_prepared")
    if require_sleep:
        require_columns(raw, ["ds_ms"], "load_prepared")
    return df


def _stem(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path.rstrip("/")))[0]


def cache_dir(source: str) -> str:
    return posixpath.join(posixpath.dirname(source.rstrip("/")), "_cache")


def parquet_path(csv_path: str) -> str:
    return posixpath.join(cache_dir(csv_path), f"{_stem(csv_path)}.parquet")


def thresholds_path(source: str, scope: str) -> str:
    return posixpath.join(cache_dir(source), f"{_stem(source)}.thresholds", f"scope={scope}")


def ensure_parquet(spark: SparkSession, csv_path: str, out: str | None = None, mode: str = "overwrite") -> str:
    """Write a CSV source once as Parquet, arrival order included, and name the result.

    ``overwrite`` renews the copy; ``ignore`` keeps one that exists, even if stale.
    """
    out = out or parquet_path(csv_path)
    read_telemetry(spark, csv_path, "csv").write.mode(mode).parquet(out)
    return out


def ensure_thresholds(
    prepared: DataFrame, scope: str, out: str, mode: str = "overwrite", decimals: int | None = None
) -> str:
    """Write the threshold table of a scope, for later runs to attach."""
    threshold_table(prepared, scope, decimals=decimals).write.mode(mode).parquet(out)
    return out


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    require_columns(table, ["tod_bin", "p30", "p70"], "read_thresholds")
    return table
