"""Report documents and chart-ready tables of a policy view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators import drift, kpis, sweep
from wattcell.operators.sampling import downsample
from wattcell.plans.policies import HEURISTIC, PolicySpec
from wattcell.schema import CELL, require_columns
from wattcell.sources.sinks import report_rows

RISK_LIMIT_PCT = 1.0
# Fixed bin widths of the cell and station histograms.
CELL_BINS = {"p_sleep": 0.05, "mean_prb": 2.0, "mean_bout_minutes": 15.0, "bouts_per_day": 0.5}
STATION_BINS = {"eco_saved_kwh": None, "eco_saved_pct": 1.0}


# -- chart-ready tables --------------------------------------------------------------


def state_bars(distribution: DataFrame) -> DataFrame:
    require_columns(distribution, ["state", "percent"], "state_bars")
    percent = F.coalesce(fx.number(F.col("percent")), F.lit(0.0))
    return distribution.select(F.col("state").cast("string").alias("state"), percent.alias("percent"))


def scatter_points(
    df: DataFrame, x: str, y: str, key: Sequence[str], keep: Sequence[str] = (), max_rows: int | None = None, seed: int = 0
) -> DataFrame:
    """Rows with both values, or a sample of ``max_rows`` of them where a chart asks for it; ``key`` identifies a row."""
    require_columns(df, [x, y, *key], "scatter_points")
    wanted = dict.fromkeys([*key, *[c for c in keep if c in df.columns], x, y])
    points = df.select(*wanted).withColumns({x: fx.number(F.col(x)), y: fx.number(F.col(y))}).dropna(subset=[x, y])
    if max_rows is None:
        return points
    identity = F.concat_ws("||", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return downsample(points, identity, max_rows, seed)


def top_scatter(top: DataFrame) -> DataFrame:
    require_columns(top, ["baseline_kwh", "eco_saved_kwh", "eco_saved_pct"], "top_scatter")
    wanted = ["bs", "baseline_kwh", "eco_saved_pct", "eco_saved_kwh", "traffic_gib", "mean_prb", "p_sleep"]
    return top.select(*[c for c in wanted if c in top.columns])


def sleep_bars(kpi: DataFrame) -> DataFrame:
    return kpis.sleep_metrics_long(kpi)


def saving_bars(kpi: DataFrame) -> DataFrame:
    wanted = kpis.with_kwh(kpi).select(*CELL, "eco_saved_pct_of_baseline", "eco_saved_kwh")
    return wanted.orderBy(F.desc_nulls_last("eco_saved_kwh"), *CELL)


# -- reports ---------------------------------------------------------------------------


def overview_report(
    view: DataFrame, spec: PolicySpec, dataset: str = "", window: str = "", ground_truth: bool = True
) -> dict:
    """Totals, state distribution and, where sleep is measured, agreement with it."""
    total = kpis.overview(view).first().asDict(recursive=True)
    out = {
        "dataset": dataset,
        "window": window,
        "base_stations": total["base_stations"],
        "cells": total["cells"],
        "traffic": {"total_kbyte": total["traffic_kbyte"], "display": total["traffic_display"]},
        "energy": {
            "baseline_wh": total["baseline_wh"],
            "eco_saved_wh": total["eco_saved_wh"],
            "eco_saved_pct": total["eco_saved_pct"],
            "display": {"baseline": total["baseline_display"], "eco_saved": total["eco_saved_display"]},
        },
        "controller": {"type": spec.controller, "alpha": spec.alpha},
    }
    if spec.controller == HEURISTIC:
        judged = kpis.bs_mean_state(view, spec.scope, spec.decimals)
        out["state_distribution"] = report_rows(state_bars(kpis.state_distribution(judged)))
        positive, name = "SLEEP", "heuristic_vs_gt_bs_level"
    else:
        out["state_distribution"] = report_rows(state_bars(kpis.state_distribution(view)))
        if "p_sleep_on" in view.columns:
            out["p_sleep_on"] = kpis.probability_summary(view).first().asDict()
        positive, name = "ECO", "eco_vs_gt_sleep_bs_level"
    if ground_truth:
        out[name] = kpis.bs_confusion(view, positive).first().asDict()
    return out


def drilldown_report(view: DataFrame, bs: str | None = None) -> dict:
    """Cells of one station (the busiest unless named), as tables, and its totals."""
    busiest = report_rows(kpis.busiest_stations(view))
    if not busiest:
        return {"busiest": [], "cells": None}
    bs = bs if bs is not None else busiest[0]["bs"]
    rows = kpis.station_rows(view, bs)
    cells = kpis.cells_by_saving(kpis.cell_kpis(rows))
    total = kpis.overview(rows).first().asDict(recursive=True)
    return {
        "busiest": busiest,
        "bs": bs,
        "cells": cells,
        "sleep_bars": sleep_bars(cells),
        "saving_bars": saving_bars(cells),
        "totals": {c: total[c] for c in total if c.startswith(("baseline", "eco_saved"))},
    }


def heterogeneity_report(view: DataFrame, ground_truth: bool = True) -> dict:
    """Spread across cells and stations: counts, coefficients of variation, histograms, scatters."""
    cells = kpis.with_kwh(kpis.cell_kpis(view)).persist()
    stations = kpis.ranked_units(kpis.bs_summary(view)).persist()
    out = {
        "n_cells": cells.count(),
        "n_stations": stations.count(),
        "cv_eco_saved_kwh": kpis.coefficient_of_variation(stations, "eco_saved_kwh").first()["cv"],
        "cells": {},
        "stations": {c: drift.histogram(stations, c, step) for c, step in STATION_BINS.items()},
        "station_points": scatter_points(stations, "mean_prb", "eco_saved_pct", ["bs"]),
    }
    shown = CELL_BINS if ground_truth else {"mean_prb": CELL_BINS["mean_prb"]}
    out["cells"] = {c: drift.histogram(cells, c, step) for c, step in shown.items()}
    if ground_truth:
        out["cv_p_sleep"] = kpis.coefficient_of_variation(cells, "p_sleep").first()["cv"]
        out["cell_points"] = scatter_points(cells, "mean_prb", "p_sleep", CELL)
    return out


def risk_report(
    view: DataFrame,
    alpha: float = 0.45,
    load_limit: float = 20.0,
    grid: Sequence[float] | None = None,
    offset: float = 0.10,
    sample_fraction: float = 1.0,
) -> dict:
    """Present risk, the sweep re-simulated on this view, and the recommended level."""
    risk = kpis.risk_metrics(view, load_limit).first().asDict()
    saved = view.agg(F.coalesce(F.sum("eco_saved_wh"), F.lit(0.0)).alias("wh")).first()["wh"]
    out = {
        "risk": risk,
        "over_limit": risk["risk_percent_total"] > RISK_LIMIT_PCT,
        "current": {"risk_pct": risk["risk_percent_total"], "saved_kwh": saved / 1000.0, "label": "Current"},
    }
    if "p_sleep_on" in view.columns:
        levels = sweep.pareto_sweep(view, alpha, grid, offset, load_limit, sample_fraction)
        # A handful of rows, one per grid level: keep them instead of sweeping twice.
        levels = view.sparkSession.createDataFrame(levels.collect(), levels.schema)
        best = report_rows(sweep.recommended_level(levels, RISK_LIMIT_PCT))
        out |= {"sweep": report_rows(levels.orderBy("tau_on")), "recommended": best[0] if best else None}
    return out


def drift_report(reference: DataFrame, current: DataFrame, feature: str = "prb") -> dict:
    """Distribution table of all features and the overlaid histogram of one."""
    return {
        "table": drift.drift_table(reference, current),
        "histogram": drift.drift_histogram(reference, current, feature),
    }
