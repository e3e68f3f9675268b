"""Quality of scores against labels, exact and without a global sort in one task.

Ranking metrics need, for every distinct score, how many rows lie above it. Rows are
first combined by score. The distinct scores are dealt to ranges that follow the data; the
running sums run inside each range and over the totals of the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators.ordered import Running, deal, running
from wattcell.operators.quantiles import quantile_row
from wattcell.schema import require_columns

LOW_P, HIGH_P = 1e-6, 1.0 - 1e-6


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows and positives per distinct score."""
    return df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")
    )


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, ranges: int | None = None) -> DataFrame:
    """One row: prevalence, rank metrics, Brier score, score spread and confusion.

    Scores are clipped away from 0 and 1. With a single class the rank metrics are NULL.
    """
    clipped = df.select(F.col(y).cast("int").alias("y"), fx.clip(F.col(p), LOW_P, HIGH_P).alias("p"))
    counts = score_counts(clipped).withColumn("_down", -F.col("p"))
    above = [
        Running("n_from_top", F.col("n"), "sum"),
        Running("pos_from_top", F.col("pos"), "sum"),
    ]
    ranked = running(deal(counts, ["_down"], "score_counts", ranges), [], ["_down"], above, ["_range"])
    n, pos, score = F.col("n"), F.col("pos"), F.col("p")
    neg = n - pos
    won = neg * (F.col("pos_from_top") - pos / F.lit(2.0))
    step = pos * F.col("pos_from_top") / F.col("n_from_top")
    error = pos * F.pow(1.0 - score, F.lit(2.0)) + neg * F.pow(score, F.lit(2.0))
    hit = score >= F.lit(float(threshold))

    def counted(what: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, what)), F.lit(0))

    sums = ranked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"),
        F.sum(pos).alias("_pos"),
        F.sum(neg).alias("_neg"),
        F.sum(won).alias("_won"),
        F.sum(step).alias("_ap"),
        F.sum(error).alias("_error"),
        F.sum(n * (score - 0.5)).alias("_off"),
        F.sum(n * F.pow(score - 0.5, F.lit(2.0))).alias("_off2"),
        counted(pos, hit).alias("tp"),
        counted(neg, hit).alias("fp"),
        counted(pos, ~hit).alias("fn"),
        counted(neg, ~hit).alias("tn"),
    )
    two = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    some = F.col("n_rows") > 0
    mean_off = F.col("_off") / F.col("n_rows")
    return sums.select(
        "n_rows",
        F.when(some, F.col("_pos") / F.col("n_rows")).alias("label_prevalence"),
        F.when(two, F.col("_won") / (F.col("_pos") * F.col("_neg").cast("double"))).alias("auroc"),
        F.when(two, F.col("_ap") / F.col("_pos")).alias("auprc"),
        F.when(some, F.col("_error") / F.col("n_rows")).alias("brier"),
        F.when(some, 0.5 + mean_off).alias("p_mean"),
        F.when(some, F.sqrt(F.greatest(F.col("_off2") / F.col("n_rows") - mean_off * mean_off, F.lit(0.0)))).alias("p_std"),
        F.lit(float(threshold)).alias("threshold"),
        "tp",
        "fp",
        "fn",
        "tn",
    )


# -- load as the only predictor -----------------------------------------------------


def load_rank_scores(df: DataFrame, load: str = "prb", y: str = "sleep_on", ranges: int | None = None) -> DataFrame:
    """Score 1 for the lowest load down to 0 for the highest, by position.

    Equal loads are ordered by ``seq``, so that a load shared by most rows is cut as well.
    """
    require_columns(df, [load, y, "seq"], "load_rank_scores")
    rows = df.filter(fx.is_finite(F.col(load))).select(F.col(load).alias("_load"), "seq", F.col(y).cast("int").alias("y"))
    dealt = deal(rows, ["_load", "seq"], "loads", ranges)
    placed = running(dealt, [], ["_load", "seq"], [Running("_place", F.lit(1), "sum")], ["_range"])
    last = max(dealt.count() - 1, 1)
    return placed.select("y", (1.0 - (F.col("_place") - 1) / F.lit(float(last))).alias("p"))


# The grid of load thresholds.
GRID_STEP, GRID_SIZE = 0.5, 201


def _threshold_counts(df: DataFrame, load: str, y: str) -> DataFrame:
    """Per grid threshold t: rows and positives with load < t, and the totals."""
    x = F.col(load)
    first = F.when(x < 0, 0).otherwise(F.least(F.floor(x / GRID_STEP) + 1, F.lit(GRID_SIZE))).cast("long")
    hist = (
        df.filter(fx.is_finite(x))
        .groupBy(first.alias("_first"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    )
    grid = df.sparkSession.range(GRID_SIZE + 1).withColumnRenamed("id", "step")
    filled = grid.join(F.broadcast(hist), F.col("step") == F.col("_first"), "left").fillna(0, ["n", "pos"])
    # 202 rows: one window partition is enough.
    summed = running(
        filled, [], ["step"], [Running("below", F.col("n"), "sum"), Running("tp", F.col("pos"), "sum")]
    )
    whole = Window.partitionBy()
    rows, positives = F.max("below").over(whole), F.max("tp").over(whole)
    counts = summed.select(
        "step",
        (F.col("step") * GRID_STEP).alias("t"),
        "tp",
        (F.col("below") - F.col("tp")).alias("fp"),
        (positives - F.col("tp")).alias("fn"),
        (rows - positives - F.col("below") + F.col("tp")).alias("tn"),
    ).filter(F.col("step") < GRID_SIZE)
    precision = fx.ratio_or_zero(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    recall = fx.ratio_or_zero(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    scored = counts.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", fx.ratio_or_zero(2 * F.col("precision") * F.col("recall"), both))


def best_load_threshold(train: DataFrame, test: DataFrame, load: str = "prb", y: str = "sleep_on") -> DataFrame:
    """Load threshold with the best F1 on ``train`` (smallest on ties), measured on ``test``."""
    best = _threshold_counts(train, load, y).orderBy(F.desc("f1"), "t").limit(1)
    chosen = best.select(
        "step",
        "t",
        F.col("f1").alias("train_f1"),
        F.col("precision").alias("train_precision"),
        F.col("recall").alias("train_recall"),
    )
    seen = _threshold_counts(test, load, y).drop("t")
    rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    prevalence = F.when(rows > 0, (F.col("tp") + F.col("fn")) / rows)
    return seen.join(F.broadcast(chosen), "step").select(
        "t", "train_f1", "train_precision", "train_recall",
        "tp", "fp", "fn", "tn", "precision", "recall", "f1",
        prevalence.alias("test_prevalence"),
    )


# -- calibration --------------------------------------------------------------------


def calibration_deciles(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Rows, mean score and label share per decile of the score.

    Bins are closed on the right, the first also on the left. Repeated decile edges
    merge; with fewer than three edges left the result is empty.
    """
    scored = df.select(F.col(y).cast("int").alias("y"), fx.clip(F.col(p), LOW_P, HIGH_P).alias("p"))
    edges = quantile_row(scored, "p", [i / 10 for i in range(11)])
    edges = sorted(set(edges)) if edges else []
    if len(edges) < 3:
        return scored.filter(F.lit(False)).groupBy(F.lit(0).alias("bin")).agg(
            F.first("p").alias("lower"), F.first("p").alias("upper"),
            F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"), F.avg("y").alias("y_rate"),
        )
    number = sum(((F.col("p") > F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    table = scored.filter(F.col("p").isNotNull()).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("p_mean"), F.avg("y").alias("y_rate")
    )
    lower = F.get(F.array(*map(F.lit, edges)), F.col("bin"))
    upper = F.get(F.array(*map(F.lit, edges)), F.col("bin") + 1)
    return table.select("bin", lower.alias("lower"), upper.alias("upper"), "n", "p_mean", "y_rate").orderBy("bin")
