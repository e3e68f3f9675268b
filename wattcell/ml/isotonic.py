"""Isotonic fit of binary labels, exact and without the rows of a column in one task.

The fit is the slope of the greatest convex minorant of the running positives. The minorant of
two neighbouring stretches follows from the minorants of each, so rows are counted per
distinct score, pooled inside ranges of scores, and the blocks left are pooled up a tree
of ranges. Blocks have different shares of positives in rising order, so n rows leave
at most about n to the power 2/3 of them, whatever the scores.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.operators.ordered import deal
from wattcell.session import materialize

FAN_IN = 32  # ranges pooled together in one step of the tree
_BLOCK = "_range long, lower double, upper double, n long, pos long"


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks joined until the share of positives rises strictly."""
    done: list[list] = []
    ordered = blocks.sort_values("lower")
    for block in zip(*(ordered[c].tolist() for c in ("lower", "upper", "n", "pos"))):
        done.append(list(block))
        # Whole numbers decide, so that equal shares are always one block.
        while len(done) > 1 and done[-2][3] * done[-1][2] >= done[-1][3] * done[-2][2]:
            _, upper, n, pos = done.pop()
            done[-1][1] = upper
            done[-1][2] += n
            done[-1][3] += pos
    out = pd.DataFrame(done, columns=["lower", "upper", "n", "pos"])
    out.insert(0, "_range", blocks["_range"].iloc[0])
    return out


def isotonic_levels(df: DataFrame, score: str, y: str, ranges: int | None = None) -> DataFrame:
    """Blocks of the rising fit: ``lower`` and ``upper`` score, rows ``n``, positives ``pos``, ``level``.

    Rows without a label, or with a score that is NULL or NaN, do not count; without rows
    there are no blocks. Equal scores share a block. ``ranges`` as in :func:`quantiles`.
    """
    rows = df.select(F.col(score).cast("double").alias("lower"), F.col(y).cast("long").alias("_y"))
    rows = rows.filter(F.col("lower").isNotNull() & ~F.isnan("lower") & F.col("_y").isNotNull())
    counts = rows.groupBy("lower").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    dealt = deal(counts, ["lower"], "label_counts", ranges)
    left = (dealt.agg(F.max("_range")).first()[0] or 0) + 1
    blocks = dealt.select(F.col("_range").cast("long").alias("_range"), "lower", F.col("lower").alias("upper"), "n", "pos")
    blocks = blocks.groupBy("_range").applyInPandas(_pooled, _BLOCK)
    while left > 1:
        above = F.floor(F.col("_range") / F.lit(FAN_IN)).alias("_range")
        blocks = blocks.select(above, "lower", "upper", "n", "pos").groupBy("_range").applyInPandas(_pooled, _BLOCK)
        left = -(-left // FAN_IN)
    return blocks.select("lower", "upper", "n", "pos", (F.col("pos") / F.col("n")).alias("level"))


def fit_isotonic(df: DataFrame, score: str, y: str) -> IsotonicRegressionModel:
    """MLlib's isotonic model over the ends of the blocks, which already rise.

    Between blocks it interpolates; outside of them the first and last level hold.
    """
    blocks = materialize(isotonic_levels(df, score, y), "isotonic_levels")
    ends = F.explode(F.array_distinct(F.array("lower", "upper")))
    points = blocks.select(ends.alias("_end"), "level", F.col("n").cast("double").alias("_weight"))
    fit = IsotonicRegression(featuresCol="_end", labelCol="level", weightCol="_weight", predictionCol="_cal")
    return fit.fit(points)
