"""Savings against risk over a grid of probability thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators.policy import ProbabilityController, probability_states
from wattcell.operators.sampling import sample_cells

GRID_POINTS = 15


def even_grid(low: float = 0.1, high: float = 0.9, points: int = GRID_POINTS) -> list[float]:
    """``points`` evenly spaced levels from ``low`` to ``high``."""
    if points == 1:
        return [float(low)]
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [float(high)]


def pareto_sweep(
    df: DataFrame,
    alpha: float = 0.45,
    grid: Sequence[float] | None = None,
    offset: float = 0.10,
    load_limit: float = 20.0,
    sample_fraction: float = 1.0,
    seed: int = 42,
    p: str = "p_sleep_on",
) -> DataFrame:
    """Per entry level: energy saved, risk share and ECO share, on all cells unless ``sample_fraction`` asks for fewer.

    Every level is one state column over the same ordered pass, so the rows are shuffled
    once and never multiplied by the grid; one aggregate then yields all levels.
    """
    grid = even_grid() if grid is None else [float(t) for t in grid]
    needed = ["bs", "cell", "day_index", "tod_bin", "seq", "prb", "rru_w", p]
    kept = df.select(*needed, *[c for c in ("hot_cell",) if c in df.columns])
    rows = sample_cells(kept, sample_fraction, seed)
    levels = {f"_s{i}": ProbabilityController(t, max(0.0, t - offset)) for i, t in enumerate(grid)}
    rows = probability_states(rows, levels, p)

    alpha, load_limit = f"{float(alpha)!r}D", f"{float(load_limit)!r}D"
    rows = rows.withColumn("_wh", F.expr(alpha) * fx.baseline_wh(F.col("rru_w")))
    sums = ["count(*) AS _all", "count(prb) AS _valid"]
    for name in levels:
        sums += [
            f"sum(IF({name} = 'ECO', _wh, 0D)) AS _wh{name}",
            f"count_if({name} = 'ECO' AND prb IS NOT NULL) AS _eco{name}",
            f"count_if({name} = 'ECO' AND prb > {load_limit}) AS _risk{name}",
        ]
    total = rows.agg(*[F.expr(e) for e in sums])
    lines = [
        f"""struct({c.tau_on!r}D AS tau_on, coalesce(_wh{name}, 0D) / 1000D AS saved_kwh,
                   IF(_valid > 0, 100D * _risk{name} / _valid, 0D) AS risk_pct,
                   IF(_all > 0, 100D * _eco{name} / _all, 0D) AS eco_coverage_pct)"""
        for name, c in levels.items()
    ]
    return total.selectExpr(f"inline(array({', '.join(lines)}))")


def safe_levels(sweep: DataFrame, max_risk_pct: float = 1.0) -> DataFrame:
    return sweep.filter(F.col("risk_pct") <= F.lit(float(max_risk_pct)))


def recommended_level(sweep: DataFrame, max_risk_pct: float = 1.0) -> DataFrame:
    """The safe level that saves most; no row when none is safe."""
    return safe_levels(sweep, max_risk_pct).orderBy(F.desc("saved_kwh"), "tau_on").limit(1)
