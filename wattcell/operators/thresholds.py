"""Load thresholds (30th and 70th percentile) per time bin and scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.operators.ordered import null_safe
from wattcell.operators.quantiles import quantiles
from wattcell.schema import ensure_threshold_columns, repair_suffixes, require_columns
from wattcell.session import materialize

SCOPE_KEYS = {
    "Global": ["tod_bin"],
    "Per-BaseStation": ["bs", "tod_bin"],
    "Per-Cell": ["bs", "cell", "tod_bin"],
}
PROBS = (0.3, 0.7)
MIN_SAMPLES = 10


def scope_keys(scope: str) -> list[str]:
    if scope not in SCOPE_KEYS:
        raise ValueError(f"unknown threshold scope {scope!r}; use one of {list(SCOPE_KEYS)}")
    return SCOPE_KEYS[scope]


def _guarded(found: DataFrame, keys: list[str], min_n: int, decimals: int | None) -> DataFrame:
    def value(i: int):
        v = F.when(F.col("n") >= min_n, F.get("q", F.lit(i)))
        return v if decimals is None else F.round(v, decimals)

    return found.select(*keys, value(0).alias("p30"), value(1).alias("p70"))


def threshold_table(
    df: DataFrame,
    scope: str = "Global",
    min_n: int = MIN_SAMPLES,
    decimals: int | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Scope keys with ``p30`` and ``p70``; NULL where fewer than ``min_n`` loads are valid.

    ``decimals`` rounds the thresholds, so that different engines agree on loads that
    equal a threshold. ``ranges`` is handed to :func:`quantiles`.
    """
    df = repair_suffixes(df)
    keys = scope_keys(scope)
    require_columns(df, [*keys, "prb"], "threshold_table")
    return _guarded(quantiles(df, keys, "prb", PROBS, ranges), keys, min_n, decimals)


def series_thresholds(df: DataFrame, min_n: int = MIN_SAMPLES, decimals: int | None = None, probs=PROBS) -> DataFrame:
    """One row: the threshold pair of all loads together."""
    return _guarded(quantiles(repair_suffixes(df), [], "prb", probs), [], min_n, decimals)


def attach_thresholds(df: DataFrame, table: DataFrame, scope: str) -> DataFrame:
    """Thresholds beside every row. NULL keys match NULL keys; two thresholds for one key are an error.

    The global table has at most 49 rows and is broadcast. The others grow with the
    network, so their join is left to Spark: a broadcast if the measured size allows
    it, else a sort-merge join whose oversized partitions adaptive execution splits.
    """
    keys = scope_keys(scope)
    require_columns(table, [*keys, "p30", "p70"], "attach_thresholds")
    df = repair_suffixes(df).drop("p30", "p70", "state")
    # One row per key; more than one would multiply the rows of df, so the job fails on it.
    twice = F.raise_error(F.lit(f"attach_thresholds: several thresholds for one key of {keys}")).cast("double")
    once = [F.when(F.count("*") > 1, twice).otherwise(F.max(p)).alias(p) for p in ("p30", "p70")]
    side = table.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(*once)
    on = null_safe(df, side, [(k, f"_t_{k}") for k in keys])
    joined = df.join(F.broadcast(side) if scope == "Global" else side, on, "left")
    return ensure_threshold_columns(joined.drop(*[f"_t_{k}" for k in keys]))


def with_thresholds(
    df: DataFrame,
    scope: str = "Global",
    table: DataFrame | None = None,
    min_n: int = MIN_SAMPLES,
    decimals: int | None = None,
) -> DataFrame:
    """Attach thresholds; if none at all is valid, one global pair serves every row.

    The check looks at the thresholds of the keys that occur in ``df``. It is one small
    job on a table that is stored, because the join reads it again right after.
    """
    keys = scope_keys(scope)
    given = table is not None
    if not given:
        table = materialize(threshold_table(df, scope, min_n, decimals), "thresholds")
    used = table
    if given:
        present = df.select(*[F.col(k).alias(f"_p_{k}") for k in keys]).distinct()
        used = table.join(present, null_safe(table, present, [(k, f"_p_{k}") for k in keys]), "left_semi")
    seen = used.agg(F.count("p30").alias("p30"), F.count("p70").alias("p70")).first()
    if seen["p30"] and seen["p70"]:
        return attach_thresholds(df, table, scope)
    pair = series_thresholds(df, min_n, decimals).first()
    low, high = (pair["p30"], pair["p70"]) if pair else (None, None)
    plain = repair_suffixes(df).drop("p30", "p70", "state")
    return plain.withColumns({"p30": F.lit(low).cast("double"), "p70": F.lit(high).cast("double")})
