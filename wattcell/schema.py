"""Column contract of a telemetry table: one row per station, cell and half hour."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The sampling interval and the source headers.
INTERVAL_SECONDS = 1800.0
INTERVAL_HOURS = 0.5
INTERVAL_MINUTES = 30.0
BINS_PER_DAY = 48
HEADERS = {
    "bs": "Base Station ID",
    "cell": "Cell ID",
    "ts": "Timestamp",
    "prb": "PRB Usage Ratio (%)",
    "traffic_kb": "Traffic Volume (KByte)",
    "users": "Number of Users",
    "bbu_w": "BBU Energy (W)",
    "rru_w": "RRU Energy (W)",
    "ds_ms": "Deep Sleep Time (Millisecond)",
}

CELL = ["bs", "cell"]
MEASURES = ["prb", "traffic_kb", "users", "bbu_w", "rru_w", "ds_ms"]
REQUIRED_KEYS = ["ts", "bs", "cell", "prb", "traffic_kb", "rru_w"]

TELEMETRY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("bs", "cell", "ts")]
    + [T.StructField(c, T.DoubleType()) for c in MEASURES]
    + [T.StructField("seq", T.LongType(), False)]
)


def normalize_name(name: str) -> str:
    """Header without byte-order mark, with plain single spaces and no padding."""
    return " ".join(str(name).replace("\ufeff", "").replace("\xa0", " ").split())


_SHORT = {normalize_name(header): key for key, header in HEADERS.items()}


def resolve(df: DataFrame, key: str) -> str:
    """Name under which the logical column ``key`` occurs in ``df``."""
    if key not in HEADERS:
        raise KeyError(f"unknown column key {key!r}; known: {sorted(HEADERS)}")
    for name in (key, HEADERS[key]):
        if name in df.columns:
            return name
    for name in df.columns:
        if _SHORT.get(normalize_name(name)) == key:
            return name
    raise KeyError(f"no column for {key!r} ({HEADERS[key]!r}) among {df.columns[:20]}")


def canonicalize(df: DataFrame) -> DataFrame:
    """Rename source headers to the short keys; clean the names of all others."""
    clean = [normalize_name(c) for c in df.columns]
    return df.toDF(*[_SHORT.get(c, c) for c in clean])


def with_headers(df: DataFrame) -> DataFrame:
    """Short keys back to the source headers, for files meant for people."""
    return df.withColumnsRenamed({k: h for k, h in HEADERS.items() if k in df.columns})


def require_columns(df: DataFrame, columns: Iterable[str], where: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing required columns {missing}; available (first 20): {df.columns[:20]}")


def validate(
    df: DataFrame,
    required_keys: Iterable[str] = (),
    required_columns: Iterable[str] = (),
    where: str = "validate",
    count_rows: bool = False,
) -> dict:
    """Check column presence. Counting rows costs a job, so it is optional."""
    resolved, missing = {}, []
    for key in required_keys:
        try:
            resolved[key] = resolve(df, key)
        except KeyError:
            missing.append(f"{key} ({HEADERS.get(key)!r})")
    missing += [c for c in required_columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing required columns {missing}; available (first 20): {df.columns[:20]}")
    return {
        "where": where,
        "n_rows": df.count() if count_rows else None,
        "n_cols": len(df.columns),
        "resolved_keys": resolved,
    }


def ensure_threshold_columns(df: DataFrame) -> DataFrame:
    absent = [c for c in ("p30", "p70") if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else df


def repair_suffixes(df: DataFrame, name: str = "prb") -> DataFrame:
    """Restore ``name`` where an earlier join left ``name_x`` and/or ``name_y``."""
    sides = [c for c in (f"{name}_x", f"{name}_y") if c in df.columns]
    if name in df.columns or not sides:
        return df
    return df.withColumn(name, F.coalesce(*map(F.col, sides))).drop(*sides)
