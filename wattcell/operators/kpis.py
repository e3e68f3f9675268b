"""Station, cell and network figures of a policy table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators.ordered import Running, running_per_cell
from wattcell.operators.prepare import SERIES_ORDER, series_slot
from wattcell.operators.quantiles import quantiles
from wattcell.operators.thresholds import series_thresholds
from wattcell.schema import CELL, INTERVAL_MINUTES, require_columns

TOP_RANKINGS = ("eco_saved_kwh", "eco_saved_pct", "baseline_kwh", "traffic_gib", "p_sleep")


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def slice_time_of_day(df: DataFrame, tod_bin: int) -> DataFrame:
    return df.filter(F.col("tod_bin") == tod_bin)


def station_rows(df: DataFrame, bs: str) -> DataFrame:
    return df.filter(F.col("bs") == bs)


# -- stations ----------------------------------------------------------------------


def bs_summary(df: DataFrame) -> DataFrame:
    require_columns(df, ["bs", "prb", "traffic_kb", "baseline_wh", "eco_saved_wh", "sleep_on"], "bs_summary")
    summed = df.groupBy("bs").agg(
        _sum0("traffic_kb").alias("traffic_kbyte"),
        F.avg("prb").alias("mean_prb"),
        _sum0("baseline_wh").alias("baseline_wh"),
        _sum0("eco_saved_wh").alias("eco_saved_wh"),
        F.avg(F.col("sleep_on").cast("int")).alias("p_sleep"),
    )
    return summed.withColumn("eco_saved_pct", fx.percent_of(F.col("eco_saved_wh"), F.col("baseline_wh")))


def bs_mean_load(df: DataFrame) -> DataFrame:
    return df.groupBy("bs").agg(F.avg("prb").alias("mean_prb"))


def bs_sleep_fraction(df: DataFrame) -> DataFrame:
    return df.groupBy("bs").agg(F.avg(F.col("sleep_on").cast("int")).alias("p_sleep_cells"))


def state_distribution(df: DataFrame, state: str = "state") -> DataFrame:
    """Percent of rows per state, largest first. The window sees one row per state."""
    counted = df.filter(F.col(state).isNotNull()).groupBy(F.col(state).alias("state")).count()
    share = 100.0 * F.col("count") / F.sum("count").over(Window.partitionBy())
    return counted.select("state", share.alias("percent")).orderBy(F.desc("percent"), "state")


def _first_known(name: str) -> Column:
    place = F.struct("bs", "cell", *SERIES_ORDER)
    return F.min_by(name, F.when(F.col(name).isNotNull(), place)).alias(name)


def bs_mean_state(view: DataFrame, scope: str = "Global", decimals: int | None = None) -> DataFrame:
    """State of every station judged by its mean load.

    The pair of thresholds is the first known one of the view (Global) or of the
    station, p30 and p70 each for itself, or the percentiles of the view (Per-Cell).
    """
    if scope == "Per-BaseStation":
        judged = view.groupBy("bs").agg(F.avg("prb").alias("mean_prb"), _first_known("p30"), _first_known("p70"))
    elif scope in ("Global", "Per-Cell"):
        pair = (
            view.agg(_first_known("p30"), _first_known("p70"))
            if scope == "Global"
            else series_thresholds(view, decimals=decimals)
        ).first()
        low, high = (pair["p30"], pair["p70"]) if pair else (None, None)
        judged = bs_mean_load(view).withColumns(
            {"p30": F.lit(low).cast("double"), "p70": F.lit(high).cast("double")}
        )
    else:
        raise ValueError(f"unknown threshold scope {scope!r}")
    return judged.withColumn("state", fx.plain_state(F.col("mean_prb"), F.col("p30"), F.col("p70")))


def load_vs_sleep(bs_states: DataFrame, view: DataFrame) -> DataFrame:
    """Mean load beside the measured sleep share of each station."""
    joined = bs_states.join(
        bs_sleep_fraction(view).withColumnRenamed("bs", "_bs"), F.col("bs").eqNullSafe(F.col("_bs")), "left"
    ).drop("_bs")
    return joined.dropna(subset=["mean_prb", "p_sleep_cells"])


def bs_confusion(df: DataFrame, positive_state: str = "SLEEP") -> DataFrame:
    """Stations with any interval in ``positive_state`` against any measured sleep."""
    if not {"sleep_on", "state"} <= set(df.columns):
        return df.sparkSession.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])
    flags = df.groupBy("bs").agg(
        F.coalesce(F.bool_or("sleep_on"), F.lit(False)).alias("gt"),
        F.coalesce(F.bool_or(F.col("state") == positive_state), F.lit(False)).alias("pred"),
    )
    gt, pred = F.col("gt"), F.col("pred")
    return flags.agg(
        F.count_if(pred & gt).alias("tp"),
        F.count_if(pred & ~gt).alias("fp"),
        F.count_if(~pred & gt).alias("fn"),
        F.count_if(~pred & ~gt).alias("tn"),
    )


# -- cells -------------------------------------------------------------------------


def mark_bouts(df: DataFrame) -> DataFrame:
    """``bout_start``: asleep now, awake before. ``bout_id``: number of the bout, 0 when awake.

    A bout may run across midnight.
    """
    df = running_per_cell(df, CELL, SERIES_ORDER, [Running("_was", F.col("sleep_on"), "prev")], series_slot())
    start = F.col("sleep_on") & ~F.coalesce(F.col("_was"), F.lit(False))
    df = df.withColumn("bout_start", start).drop("_was")
    number = Running("_bouts", F.col("bout_start").cast("int"), "sum")
    df = running_per_cell(df, CELL, SERIES_ORDER, [number], series_slot())
    return df.withColumn("bout_id", F.when(F.col("sleep_on"), F.col("_bouts")).otherwise(0)).drop("_bouts")


def cell_kpis(df: DataFrame) -> DataFrame:
    """Sleep, load and energy figures per (station, cell)."""
    require_columns(df, [*CELL, "sleep_on", "sleep_frac", "baseline_wh", "eco_saved_wh"], "cell_kpis")
    slept = F.col("sleep_on").cast("int")
    df = running_per_cell(df, CELL, SERIES_ORDER, [Running("_was", F.col("sleep_on"), "prev")], series_slot())
    start = (F.col("sleep_on") & ~F.coalesce(F.col("_was"), F.lit(False))).cast("int")
    out = df.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("day_index").alias("n_days"),
        F.avg(slept).alias("p_sleep"),
        F.avg("sleep_frac").alias("f_sleep"),
        F.sum(start).alias("n_bouts"),
        F.sum(slept).alias("_asleep"),
        F.avg("prb").alias("mean_prb"),
        F.avg("rru_w").alias("mean_rru_w"),
        _sum0("baseline_wh").alias("baseline_wh"),
        _sum0("eco_saved_wh").alias("eco_saved_wh"),
    )
    mean_bout = fx.ratio_or_zero(F.col("_asleep").cast("double"), F.col("n_bouts"))
    return out.select(
        *CELL,
        "n_rows",
        "n_days",
        "p_sleep",
        "f_sleep",
        "n_bouts",
        (F.col("n_bouts") / F.greatest(F.lit(1), F.col("n_days"))).alias("bouts_per_day"),
        mean_bout.alias("mean_bout_intervals"),
        (mean_bout * INTERVAL_MINUTES).alias("mean_bout_minutes"),
        "mean_prb",
        "mean_rru_w",
        "baseline_wh",
        "eco_saved_wh",
        fx.percent_of(F.col("eco_saved_wh"), F.col("baseline_wh")).alias("eco_saved_pct_of_baseline"),
    )


def with_kwh(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "baseline_kwh": fx.wh_to_kwh(F.col("baseline_wh")),
            "eco_saved_kwh": fx.wh_to_kwh(F.col("eco_saved_wh")),
        }
    )


def cells_by_saving(kpis: DataFrame) -> DataFrame:
    return with_kwh(kpis).orderBy(F.desc_nulls_last("eco_saved_wh"), *CELL)


def sleep_metrics_long(kpis: DataFrame) -> DataFrame:
    """The two sleep shares of each cell as (metric, value) rows."""
    wide = kpis.select(
        *CELL, F.col("p_sleep").alias("P(sleep_on)"), F.col("f_sleep").alias("Sleep time fraction")
    )
    return wide.unpivot(CELL, ["P(sleep_on)", "Sleep time fraction"], "metric", "value")


# -- network -----------------------------------------------------------------------


def overview(df: DataFrame) -> DataFrame:
    """One row of totals. Cells are counted by cell id alone.

    Rows are combined per (station, cell) first: counting two sets of distinct values
    multiplies its input, which should then be small.
    """
    measures = {"traffic_kb": "traffic_kbyte", "baseline_wh": "baseline_wh", "eco_saved_wh": "eco_saved_wh"}
    per_cell = df.groupBy(*CELL).agg(*[F.sum(c).alias(name) for c, name in measures.items()])
    totals = per_cell.agg(
        F.countDistinct("bs").alias("base_stations"),
        F.countDistinct("cell").alias("cells"),
        *[_sum0(name).alias(name) for name in measures.values()],
    )
    return totals.withColumns(
        {
            "eco_saved_pct": fx.percent_of(F.col("eco_saved_wh"), F.col("baseline_wh")),
            "traffic_display": fx.traffic_display(F.col("traffic_kbyte")),
            "baseline_display": fx.energy_display(F.col("baseline_wh")),
            "eco_saved_display": fx.energy_display(F.col("eco_saved_wh")),
        }
    )


def with_risk_flags(df: DataFrame, load_limit: float = 20.0) -> DataFrame:
    """Per interval: ECO, loaded beyond the limit, and both at once."""
    eco = F.coalesce(F.col("state") == "ECO", F.lit(False))
    high = F.coalesce(F.col("prb") > F.lit(float(load_limit)), F.lit(False))
    return df.withColumns({"is_eco": eco, "is_high_load": high, "is_risk": eco & high})


def risk_metrics(df: DataFrame, load_limit: float = 20.0) -> DataFrame:
    """One row: how often ECO coincides with a load beyond the limit."""
    require_columns(df, ["state", "prb"], "risk_metrics")
    flagged = with_risk_flags(df.dropna(subset=["state", "prb"]), load_limit)
    counted = flagged.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if("is_risk").alias("risk_intervals"),
        F.count_if("is_eco").alias("eco_intervals"),
    )
    risk = F.col("risk_intervals").cast("double")
    return counted.select(
        "risk_intervals",
        fx.percent_of(risk, F.col("_n")).alias("risk_percent_total"),
        fx.percent_of(risk, F.col("eco_intervals")).alias("risk_percent_eco"),
        "eco_intervals",
    )


def probability_summary(df: DataFrame, p: str = "p_sleep_on") -> DataFrame:
    """One row: mean, population deviation and upper quantiles of a score."""
    spread = df.agg(F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"))
    upper = quantiles(df, [], p, (0.9, 0.99)).select(F.get("q", F.lit(0)).alias("p90"), F.get("q", F.lit(1)).alias("p99"))
    return spread.withColumns({c: upper.select(c).scalar() for c in ("p90", "p99")})


def score_profile(df: DataFrame, p: str = "p_sleep_on") -> DataFrame:
    """Mean and quantiles of a score per time of day (48 rows)."""
    scored = df.filter(F.col(p).isNotNull())
    means = scored.groupBy("tod_bin").agg(F.avg(p).alias("p_mean"))
    spread = quantiles(scored, ["tod_bin"], p, (0.5, 0.1, 0.9)).withColumnRenamed("tod_bin", "_bin")
    joined = means.join(F.broadcast(spread), F.col("tod_bin").eqNullSafe(F.col("_bin")))
    return joined.select(
        "tod_bin",
        "p_mean",
        F.get("q", F.lit(0)).alias("p_median"),
        F.get("q", F.lit(1)).alias("p10"),
        F.get("q", F.lit(2)).alias("p90"),
        "n",
        fx.time_label(F.col("tod_bin")).alias("time_of_day"),
    ).orderBy("tod_bin")


def coefficient_of_variation(df: DataFrame, column: str) -> DataFrame:
    """One row: population deviation over mean, NULL unless the mean is positive."""
    cv = F.when(F.avg(column) > 0, F.stddev_pop(column) / F.avg(column))
    return df.agg(cv.alias("cv"))


def dataset_summary(df: DataFrame, p: str | None = None) -> DataFrame:
    """One row: rows, stations, cell ids, and the sleep share or mean score if present."""
    means = {}
    if "sleep_on" in df.columns:
        means["label_prevalence"] = F.col("sleep_on").cast("int")
    if p:
        means["p_mean"] = F.col(p)
    parts = [F.count(F.lit(1)).alias("_n")]
    for name, value in means.items():
        parts += [F.sum(value).alias(f"_sum_{name}"), F.count(value).alias(f"_n_{name}")]
    per_cell = df.groupBy(*CELL).agg(*parts)

    def mean(name: str) -> Column:
        rows = F.sum(f"_n_{name}")
        return F.when(rows > 0, F.sum(f"_sum_{name}") / rows).alias(name)

    return per_cell.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.countDistinct("bs").alias("n_bs"),
        F.countDistinct("cell").alias("n_cells"),
        *[mean(name) for name in means],
    )


# -- rankings ----------------------------------------------------------------------


def ranked_units(summary: DataFrame) -> DataFrame:
    return with_kwh(summary).withColumn("traffic_gib", fx.kb_to_gib(F.col("traffic_kbyte")))


def top_stations(summary: DataFrame, by: str = "eco_saved_kwh", n: int = 10, ascending: bool = False) -> DataFrame:
    """The n best stations with their rank. Only those n rows are numbered."""
    if by not in TOP_RANKINGS:
        raise ValueError(f"cannot rank by {by!r}; use one of {TOP_RANKINGS}")
    units = ranked_units(summary)
    key = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    best = units.orderBy(key, "bs").limit(n)
    numbered = best.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(key, "bs")))
    return numbered.select(
        "rank", "bs", "traffic_gib", "mean_prb", "baseline_kwh", "eco_saved_kwh", "eco_saved_pct", "p_sleep"
    )


def busiest_stations(df: DataFrame, n: int = 25) -> DataFrame:
    summed = df.groupBy("bs").agg(_sum0("traffic_kb").alias("traffic_kbyte"))
    return summed.orderBy(F.desc_nulls_last("traffic_kbyte"), "bs").limit(n)


# -- fixed tiers -------------------------------------------------------------------


def with_tiers(df: DataFrame, traffic: str, installed: int = 4) -> DataFrame:
    tier = fx.traffic_tier(F.col(traffic))
    return df.withColumns(
        {
            "tier": tier,
            "tier_energy": fx.tier_energy(tier),
            "receivers": fx.active_receivers(F.col(traffic), F.lit(int(installed))),
        }
    )


def fleet_energy(tiered: DataFrame) -> DataFrame:
    return tiered.agg(_sum0("tier_energy").alias("total_energy"))
