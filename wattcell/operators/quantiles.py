"""Exact quantiles with linear interpolation, per group, by one rule at every size.

Rows are counted per key and distinct value, and the counts are dealt to ranges in the order
of key and value. No pair of key and value occurs twice there, so the ranges are even however
often a value or a key repeats. The totals of the ranges tell which range holds a wanted
rank; only those ranges are ordered by value. No window sees more rows than one range, or
one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattcell.operators.ordered import deal, null_safe


def quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """One row per ``keys``: ``n`` valid values and ``q``, the array of quantiles.

    Without a valid value ``n`` is 0 and ``q`` NULL. Without ``keys`` there is always one
    row. NaN counts as the largest value. ``ranges`` is the number of ranges; by default
    the session's number of shuffle partitions, merged where they are small.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    values = df.select(*keys, F.col(column).cast("double").alias("_v"))
    counts = values.groupBy(*keys, "_v").agg(F.count("_v").alias("_c"))
    counts = deal(counts, [*keys, "_v"], "value_counts", ranges)

    group = Window.partitionBy(*keys)
    before = F.sum("_size").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("_c").alias("_size"))
    spans = sizes.withColumns({"n": F.sum("_size").over(group), "_before": before})

    def place(p: float) -> Column:
        return F.lit(p) * (F.col("n") - 1)

    ranks = F.array(*[rank(place(p)) for p in probs for rank in (F.floor, F.ceil)])
    end = F.col("_before") + F.col("_size")
    # Keys without a single valid value have no rank to find; they come along with their one NULL.
    holding = spans.filter((F.col("n") == 0) | F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < end)))
    side = holding.select("n", "_before", *[F.col(k).alias(f"_s_{k}") for k in [*keys, "_range"]])
    on = null_safe(counts, side, [(k, f"_s_{k}") for k in [*keys, "_range"]])
    inside = counts.join(side, on).filter("_c > 0 OR n = 0")
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select(*keys, "n", "_v", (F.col("_before") + F.sum("_c").over(in_range)).alias("_upto"))

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    picks = []
    for i, p in enumerate(probs):
        picks += [at_rank(F.floor(place(p))).alias(f"_f{i}"), at_rank(F.ceil(place(p))).alias(f"_c{i}")]
    found = ranked.groupBy(*keys, "n").agg(*picks)
    out = []
    for i, p in enumerate(probs):
        low, high = F.col(f"_f{i}"), F.col(f"_c{i}")
        between = (F.ceil(place(p)) - place(p)) * low + (place(p) - F.floor(place(p))) * high
        out.append(F.when(low == high, low).otherwise(between))
    exact = found.select(*keys, "n", F.when(F.col("n") > 0, F.array(*out)).alias("q"))
    if keys:
        return exact
    return exact.agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"), F.max("q").alias("q"))


def quantile_row(df: DataFrame, column: str, probs: Sequence[float]) -> list[float] | None:
    """Quantiles of a whole column as a short driver-side list; None without values."""
    row = quantiles(df, [], column, probs).first()
    return list(row["q"]) if row["n"] else None


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several columns, ranked together with the column's number as key."""
    each = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])
    long = df.select(F.explode(each).alias("_e")).select("_e.*")
    found = {row["_i"]: row["q"][0] for row in quantiles(long, ["_i"], "_x", [0.5]).collect() if row["n"]}
    return {c: found.get(i) for i, c in enumerate(columns)}
