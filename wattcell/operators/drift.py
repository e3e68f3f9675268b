"""Histograms and distribution shift between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.functions import columns as fx

# Compared features: the column in the units shown to people.
FEATURES = {
    "prb": lambda: F.col("prb"),
    "users": lambda: F.col("users"),
    "traffic_gib": lambda: fx.kb_to_gib(F.col("traffic_kb")),
}
REFERENCE, CURRENT = "reference", "current"


def labelled_union(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both tables' features below each other, with the name of the table."""

    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(F.lit(label).alias("dataset"), *[make().alias(name) for name, make in FEATURES.items()])

    return side(reference, REFERENCE).unionByName(side(current, CURRENT))


def drift_table(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each feature, side by side."""
    both = labelled_union(reference, current)
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    sums, cells = [], []
    for feature in FEATURES:
        for name, measure in measures.items():
            for label in (REFERENCE, CURRENT):
                value = F.when(F.col("dataset") == label, F.col(feature))
                sums.append(measure(value).alias(f"{feature}_{name}_{label}"))
            cells.append(
                F.struct(
                    F.lit(feature).alias("feature"),
                    F.lit(name).alias("metric"),
                    F.col(f"{feature}_{name}_{REFERENCE}").alias(REFERENCE),
                    F.col(f"{feature}_{name}_{CURRENT}").alias(CURRENT),
                )
            )
    return both.agg(*sums).select(F.inline(F.array(*cells)))


def round_step(span: float, max_bins: int) -> float:
    """Smallest step of the form 1, 2 or 5 times a power of ten with at most ``max_bins`` bins."""
    for exponent in range(-12, 19):
        for lead in (1, 2, 5):
            step = float(f"{lead}e{exponent}")
            if span / step <= max_bins:
                return step
    raise ValueError(f"no step for a span of {span}")


def chosen_step(df: DataFrame, column: str, max_bins: int) -> float:
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if ends["low"] is None:
        return 1.0
    return round_step((ends["high"] - ends["low"]) or abs(ends["low"]) or 1.0, max_bins)


def _bin_number(column: str, step: float) -> Column:
    return F.floor(F.col(column) / F.lit(step))


def histogram(df: DataFrame, column: str, step: float | None = None, max_bins: int = 30) -> DataFrame:
    """Rows per left-closed bin of a fixed step, or of a round step with few bins."""
    valued = df.filter(fx.is_finite(F.col(column)))
    step = chosen_step(valued, column, max_bins) if step is None else float(step)
    counted = valued.groupBy(_bin_number(column, step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select((F.col("bin") * F.lit(step)).alias("bin_start"), "n").orderBy("bin_start")


def drift_histogram(reference: DataFrame, current: DataFrame, feature: str, max_bins: int = 40) -> DataFrame:
    """Both tables over common bins, from all rows."""
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature!r}; use one of {list(FEATURES)}")
    both = labelled_union(reference, current).filter(fx.is_finite(F.col(feature)))
    step = chosen_step(both, feature, max_bins)
    counted = both.groupBy("dataset", _bin_number(feature, step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("dataset", (F.col("bin") * F.lit(step)).alias("bin_start"), "n").orderBy("dataset", "bin_start")
