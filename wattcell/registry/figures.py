"""Summaries: stations, cells, network, rankings, sweep, drift and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattcell.operators import drift, kpis, sweep
from wattcell.plans import reports
from wattcell.plans.policies import LEARNED, PolicySpec, bs_summary_of, cell_kpis_of, view
from wattcell.registry.base import (
    ALPHA,
    DECIMALS,
    PREP,
    n,
    pol_hysteresis,
    pol_plain,
    pol_probability,
    policy,
    prepared,
    query,
    r,
    score_sql,
    scored,
    sql,
)
from wattcell.sources.adapters import is_weekday


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN 100.0 * ({part}) / ({whole}) ELSE 0 END"


# -- stations ------------------------------------------------------------------------


def _bs_sql(where: str = "") -> str:
    return f"""
bs_sum AS (
  SELECT bs, coalesce(sum(traffic_kb), 0) AS traffic_kbyte, avg(prb) AS mean_prb,
         coalesce(sum(baseline_wh), 0) AS baseline_wh, coalesce(sum(eco_saved_wh), 0) AS eco_saved_wh,
         avg(CASE WHEN sleep_on THEN 1.0 ELSE 0.0 END) AS p_sleep
  FROM pol {where} GROUP BY bs)"""


_BS_OUT = f"""
SELECT bs, {r('traffic_kbyte')}, {r('mean_prb')}, {r('baseline_wh')}, {r('eco_saved_wh')}, {r('p_sleep')},
       {r(_pct('eco_saved_wh', 'baseline_wh'), 'eco_saved_pct')}
FROM bs_sum"""


@query("bs_summary", sql(pol_plain(), _bs_sql(), _BS_OUT))
def bs_summary(spark, sf_dir):
    return kpis.bs_summary(policy(spark, sf_dir))


@query("bs_summary_hysteresis", sql(pol_hysteresis(), _bs_sql(), _BS_OUT))
def bs_summary_hysteresis(spark, sf_dir):
    return bs_summary_of(prepared(spark, sf_dir), PolicySpec(alpha=ALPHA, decimals=DECIMALS))


@query("bs_summary_time_bin", sql(pol_hysteresis(), _bs_sql("WHERE tod_bin = 18"), _BS_OUT))
def bs_summary_bin(spark, sf_dir):
    """States of the whole day, summed over one half hour of it."""
    return bs_summary_of(prepared(spark, sf_dir), PolicySpec(alpha=ALPHA, decimals=DECIMALS), tod_bin=18)


@query("bs_summary_probability", sql(score_sql(), pol_probability([(0.8, 0.7)]), _bs_sql(), _BS_OUT))
def bs_summary_probability(spark, sf_dir):
    return bs_summary_of(scored(spark, sf_dir), PolicySpec(controller=LEARNED, alpha=ALPHA))


@query("bs_mean_load", sql(PREP, f"SELECT bs, {r('avg(prb)', 'mean_prb')} FROM prep GROUP BY bs"))
def bs_mean_load(spark, sf_dir):
    return kpis.bs_mean_load(prepared(spark, sf_dir))


@query("gt_sleep_fraction", sql(PREP, f"""
SELECT bs, {r('avg(CASE WHEN sleep_on THEN 1.0 ELSE 0.0 END)', 'p_sleep_cells')} FROM prep GROUP BY bs"""))
def gt_sleep_fraction(spark, sf_dir):
    return kpis.bs_sleep_fraction(prepared(spark, sf_dir))


_PLACE = "bs, cell, day_index, tod_bin, seq"
_MEAN = "mean_load AS (SELECT bs, avg(prb) AS mean_prb FROM pol GROUP BY bs)"
_JUDGE = """CASE WHEN mean_prb IS NULL OR p30 IS NULL OR p70 IS NULL THEN 'UNKNOWN' WHEN mean_prb < p30 THEN 'SLEEP'
            WHEN mean_prb < p70 THEN 'ECO' ELSE 'FULL' END AS state"""


def _judged(scope: str) -> str:
    if scope == "Global":
        pair = ", ".join(
            f"(SELECT {c} FROM pol WHERE {c} IS NOT NULL ORDER BY {_PLACE} LIMIT 1) AS {c}" for c in ("p30", "p70")
        )
        source = f"SELECT bs, mean_prb, {pair} FROM mean_load"
    elif scope == "Per-BaseStation":
        firsts = [
            f"f_{c} AS (SELECT bs, {c} FROM (SELECT bs, {c}, row_number() OVER (PARTITION BY bs ORDER BY {_PLACE}) AS rk "
            f"FROM pol WHERE {c} IS NOT NULL) WHERE rk = 1)"
            for c in ("p30", "p70")
        ]
        source = "SELECT bs, mean_prb, p30, p70 FROM mean_load LEFT JOIN f_p30 USING (bs) LEFT JOIN f_p70 USING (bs)"
        return f"{_MEAN}, {', '.join(firsts)}, judged AS (SELECT *, {_JUDGE} FROM ({source}))"
    else:
        source = "SELECT bs, mean_prb, g.p30, g.p70 FROM mean_load, whole g"
    return f"{_MEAN}, judged AS (SELECT *, {_JUDGE} FROM ({source}))"


for _scope, _name in (("Global", "global"), ("Per-BaseStation", "bs"), ("Per-Cell", "cell")):

    @query(f"bs_mean_state_{_name}", sql(pol_plain(_scope), _judged(_scope), f"""
SELECT bs, {r('mean_prb')}, p30, p70, state FROM judged"""))
    def bs_mean_state(spark, sf_dir, scope=_scope):
        return kpis.bs_mean_state(policy(spark, sf_dir, scope), scope, DECIMALS)


@query("state_distribution", sql(pol_hysteresis(), f"""
SELECT state, {r('100.0 * count(*) / (SELECT count(*) FROM pol)', 'percent')} FROM pol GROUP BY state"""))
def state_distribution(spark, sf_dir):
    return reports.state_bars(kpis.state_distribution(policy(spark, sf_dir, hysteresis=True)))


@query("state_distribution_stations", sql(pol_plain(), _judged("Global"), f"""
SELECT state, {r('100.0 * count(*) / (SELECT count(*) FROM judged)', 'percent')} FROM judged GROUP BY state"""))
def state_distribution_stations(spark, sf_dir):
    return kpis.state_distribution(kpis.bs_mean_state(policy(spark, sf_dir), "Global"))


@query("load_vs_sleep", sql(pol_plain(), _judged("Global"), f"""
SELECT bs, {r('mean_prb')}, state, {r('p_sleep_cells')}
FROM judged LEFT JOIN (SELECT bs, avg(CASE WHEN sleep_on THEN 1.0 ELSE 0.0 END) AS p_sleep_cells FROM pol GROUP BY bs)
USING (bs) WHERE mean_prb IS NOT NULL AND p_sleep_cells IS NOT NULL"""))
def load_vs_sleep(spark, sf_dir):
    rows = policy(spark, sf_dir)
    return kpis.load_vs_sleep(kpis.bs_mean_state(rows, "Global"), rows).select("bs", "mean_prb", "state", "p_sleep_cells")


for _state in ("SLEEP", "ECO"):

    @query(f"bs_confusion_{_state.lower()}", sql(pol_hysteresis(), f"""
, flags AS (SELECT bs, coalesce(bool_or(sleep_on), false) AS gt, coalesce(bool_or(state = '{_state}'), false) AS pred
            FROM pol WHERE tod_bin = 18 GROUP BY bs)
SELECT {n('count(*) FILTER (pred AND gt)', 'tp')}, {n('count(*) FILTER (pred AND NOT gt)', 'fp')},
       {n('count(*) FILTER (NOT pred AND gt)', 'fn')}, {n('count(*) FILTER (NOT pred AND NOT gt)', 'tn')} FROM flags"""))
    def bs_confusion(spark, sf_dir, state=_state):
        """On the view of one half hour, where not every station has slept."""
        return kpis.bs_confusion(view(policy(spark, sf_dir, hysteresis=True), 18), state)


# -- cells ---------------------------------------------------------------------------


def _cell_sql(where: str = "") -> str:
    return f"""
started AS (
  SELECT *, CASE WHEN sleep_on AND NOT coalesce(lag(sleep_on) OVER w, false) THEN 1 ELSE 0 END AS bout_start
  FROM pol {where} WINDOW w AS (PARTITION BY bs, cell ORDER BY day_index, tod_bin, seq)),
bouts AS (
  SELECT bs, cell, avg(len) AS mean_len FROM (
    SELECT bs, cell, bout, count(*) AS len FROM (
      SELECT bs, cell, sleep_on, sum(bout_start) OVER (PARTITION BY bs, cell ORDER BY day_index, tod_bin, seq) AS bout
      FROM started) WHERE sleep_on GROUP BY bs, cell, bout) GROUP BY bs, cell),
figures AS (
  SELECT bs, cell, count(*) AS n_rows, count(DISTINCT day_index) AS n_days,
         avg(CASE WHEN sleep_on THEN 1.0 ELSE 0.0 END) AS p_sleep, avg(sleep_frac) AS f_sleep,
         sum(bout_start) AS n_bouts, avg(prb) AS mean_prb, avg(rru_w) AS mean_rru_w,
         coalesce(sum(baseline_wh), 0) AS baseline_wh, coalesce(sum(eco_saved_wh), 0) AS eco_saved_wh
  FROM started GROUP BY bs, cell),
cell_kpi AS (
  SELECT f.bs, f.cell, n_rows, n_days, p_sleep, f_sleep, n_bouts, n_bouts / greatest(1, n_days) AS bouts_per_day,
         coalesce(mean_len, 0) AS mean_bout_intervals, coalesce(mean_len, 0) * 30 AS mean_bout_minutes, mean_prb,
         mean_rru_w, baseline_wh, eco_saved_wh, {_pct('eco_saved_wh', 'baseline_wh')} AS eco_saved_pct_of_baseline,
         baseline_wh / 1000 AS baseline_kwh, eco_saved_wh / 1000 AS eco_saved_kwh
  FROM figures f LEFT JOIN bouts b ON f.bs = b.bs AND f.cell = b.cell)"""


_CELL_COLUMNS = f"""bs, cell, n_rows, n_days, {r('p_sleep')}, {r('f_sleep')}, {n('n_bouts', 'n_bouts')},
       {r('bouts_per_day')}, {r('mean_bout_intervals')}, {r('mean_bout_minutes')}, {r('mean_prb')}, {r('mean_rru_w')},
       {r('baseline_wh')}, {r('eco_saved_wh')}, {r('eco_saved_pct_of_baseline')}"""
_CELL_OUT = f"SELECT {_CELL_COLUMNS} FROM cell_kpi"
_CELL_KWH_OUT = f"SELECT {_CELL_COLUMNS}, {r('baseline_kwh')}, {r('eco_saved_kwh')} FROM cell_kpi"


@query("cell_kpis", sql(pol_hysteresis(), _cell_sql(), _CELL_OUT))
def cell_kpis(spark, sf_dir):
    return cell_kpis_of(prepared(spark, sf_dir), PolicySpec(alpha=ALPHA, decimals=DECIMALS))


@query("cell_kpis_time_bin", sql(pol_hysteresis(), _cell_sql("WHERE tod_bin = 18"), _CELL_OUT))
def cell_kpis_bin(spark, sf_dir):
    return cell_kpis_of(prepared(spark, sf_dir), PolicySpec(alpha=ALPHA, decimals=DECIMALS), tod_bin=18)


@query("cell_kpis_split_cells", sql(pol_hysteresis(), _cell_sql(), _CELL_OUT))
def cell_kpis_split(spark, sf_dir):
    rows = prepared(spark, sf_dir, hot_cell_rows=1)
    return cell_kpis_of(rows, PolicySpec(alpha=ALPHA, decimals=DECIMALS))


@query("cells_by_saving", sql(pol_plain(), _cell_sql(), _CELL_KWH_OUT))
def cells_by_saving(spark, sf_dir):
    return kpis.cells_by_saving(kpis.cell_kpis(policy(spark, sf_dir)))


@query("cell_metrics_long", sql(pol_plain(), _cell_sql(), f"""
SELECT bs, cell, 'P(sleep_on)' AS metric, {r('p_sleep', 'value')} FROM cell_kpi
UNION ALL SELECT bs, cell, 'Sleep time fraction', {r('f_sleep', 'value')} FROM cell_kpi"""))
def cell_metrics_long(spark, sf_dir):
    return reports.sleep_bars(kpis.cell_kpis(policy(spark, sf_dir)))


@query("cell_saving_bars", sql(pol_plain(), _cell_sql(), f"""
SELECT bs, cell, {r('eco_saved_pct_of_baseline')}, {r('eco_saved_kwh')} FROM cell_kpi"""))
def cell_saving_bars(spark, sf_dir):
    return reports.saving_bars(kpis.cell_kpis(policy(spark, sf_dir)))


@query("drilldown_cells", sql(pol_plain(), """
busiest AS (SELECT bs FROM pol GROUP BY bs ORDER BY sum(traffic_kb) DESC, bs LIMIT 1)""",
    _cell_sql("WHERE bs = (SELECT bs FROM busiest)"), _CELL_KWH_OUT))
def drilldown_cells(spark, sf_dir):
    return reports.drilldown_report(policy(spark, sf_dir))["cells"]


# -- network -------------------------------------------------------------------------


def _energy_display(wh: str, name: str) -> str:
    return f"""format('{{:,.3f}}', CASE WHEN abs({wh}) >= 1000000 THEN {wh} / 1000000 ELSE {wh} / 1000 END) AS {name}_value,
       CASE WHEN abs({wh}) >= 1000000 THEN 'MWh' ELSE 'kWh' END AS {name}_unit"""


@query("overview", sql(pol_plain(), """
total AS (
  SELECT count(DISTINCT bs) AS base_stations, count(DISTINCT cell) AS cells, sum(traffic_kb) AS traffic_kbyte,
         sum(baseline_wh) AS baseline_wh, sum(eco_saved_wh) AS eco_saved_wh,
         sum(traffic_kb) / (1024.0 * 1024.0) AS gib FROM pol)""", f"""
SELECT base_stations, cells, {r('traffic_kbyte')}, {r('baseline_wh')}, {r('eco_saved_wh')},
       {r(_pct('eco_saved_wh', 'baseline_wh'), 'eco_saved_pct')},
       format('{{:,.3f}}', CASE WHEN abs(gib) >= 1024 THEN gib / 1024 ELSE gib END) AS traffic_value,
       CASE WHEN abs(gib) >= 1024 THEN 'TiB' ELSE 'GiB' END AS traffic_unit,
       {_energy_display('baseline_wh', 'baseline')}, {_energy_display('eco_saved_wh', 'eco_saved')}
FROM total"""))
def overview(spark, sf_dir):
    found = kpis.overview(policy(spark, sf_dir))
    parts = [
        F.col(f"{name}_display.{part}").alias(f"{name}_{part}")
        for name in ("traffic", "baseline", "eco_saved")
        for part in ("value", "unit")
    ]
    plain = ["base_stations", "cells", "traffic_kbyte", "baseline_wh", "eco_saved_wh", "eco_saved_pct"]
    return found.select(*plain, *parts)


def _risk_sql(where: str) -> str:
    return f"""
, v AS (SELECT * FROM pol WHERE state IS NOT NULL AND prb IS NOT NULL {where}),
c AS (SELECT count(*) AS total, count(*) FILTER (state = 'ECO' AND prb > 20) AS risk,
             count(*) FILTER (state = 'ECO') AS eco FROM v)
SELECT risk AS risk_intervals, {r(_pct('risk', 'total'), 'risk_percent_total')},
       {r(_pct('risk', 'eco'), 'risk_percent_eco')}, eco AS eco_intervals FROM c"""


@query("risk_metrics", sql(pol_hysteresis(), _risk_sql("")))
def risk_metrics(spark, sf_dir):
    return kpis.risk_metrics(policy(spark, sf_dir, hysteresis=True))


@query("risk_metrics_time_bin", sql(pol_hysteresis(), _risk_sql("AND tod_bin = 18")))
def risk_metrics_bin(spark, sf_dir):
    return kpis.risk_metrics(view(policy(spark, sf_dir, hysteresis=True), 18))


@query("dataset_summary", sql(score_sql(), f"""
SELECT {n('count(*)', 'n_rows')}, count(DISTINCT bs) AS n_bs, count(DISTINCT cell) AS n_cells,
       {r('avg(CASE WHEN sleep_on THEN 1.0 ELSE 0.0 END)', 'label_prevalence')}, {r('avg(p_sleep_on)', 'p_mean')} FROM sc"""))
def dataset_summary(spark, sf_dir):
    return kpis.dataset_summary(scored(spark, sf_dir), "p_sleep_on")


@query("prob_summary", sql(score_sql(), f"""
SELECT {r('avg(p_sleep_on)', 'p_mean')}, {r('stddev_pop(p_sleep_on)', 'p_std')},
       {r('quantile_cont(p_sleep_on, 0.9)', 'p90')}, {r('quantile_cont(p_sleep_on, 0.99)', 'p99')} FROM sc"""))
def prob_summary(spark, sf_dir):
    return kpis.probability_summary(scored(spark, sf_dir))


@query("score_profile", sql(score_sql(), f"""
SELECT tod_bin, {r('avg(p_sleep_on)', 'p_mean')}, {r('quantile_cont(p_sleep_on, 0.5)', 'p_median')},
       {r('quantile_cont(p_sleep_on, 0.1)', 'p10')}, {r('quantile_cont(p_sleep_on, 0.9)', 'p90')},
       {n('count(*)', 'n')}, format('{{:02d}}:{{:02d}}', tod_bin // 2, tod_bin % 2 * 30) AS time_of_day
FROM sc GROUP BY tod_bin"""))
def score_profile(spark, sf_dir):
    return kpis.score_profile(scored(spark, sf_dir))


@query("cv_cells", sql(pol_plain(), _cell_sql(), f"""
SELECT {r('CASE WHEN avg(p_sleep) > 0 THEN stddev_pop(p_sleep) / avg(p_sleep) END', 'cv')} FROM cell_kpi"""))
def cv_cells(spark, sf_dir):
    return kpis.coefficient_of_variation(kpis.cell_kpis(policy(spark, sf_dir)), "p_sleep")


@query("cv_stations", sql(pol_plain(), _bs_sql(), f"""
SELECT {r('CASE WHEN avg(eco_saved_wh) > 0 THEN stddev_pop(eco_saved_wh) / avg(eco_saved_wh) END', 'cv')} FROM bs_sum"""))
def cv_stations(spark, sf_dir):
    return kpis.coefficient_of_variation(kpis.with_kwh(kpis.bs_summary(policy(spark, sf_dir))), "eco_saved_kwh")


# -- rankings ------------------------------------------------------------------------

_UNITS = """
units AS (SELECT bs, traffic_kbyte / (1024.0 * 1024.0) AS traffic_gib, mean_prb, baseline_wh / 1000 AS baseline_kwh,
                 eco_saved_wh / 1000 AS eco_saved_kwh,
                 CASE WHEN baseline_wh > 0 THEN 100.0 * eco_saved_wh / baseline_wh ELSE 0 END AS eco_saved_pct, p_sleep
          FROM bs_sum)"""


def _top_sql(by: str, count: int, direction: str) -> str:
    return sql(pol_plain(), _bs_sql(), _UNITS, f"""
SELECT {n(f'row_number() OVER (ORDER BY {by} {direction} NULLS LAST, bs)', 'rank')}, bs, {r('traffic_gib')}, {r('mean_prb')},
       {r('baseline_kwh')}, {r('eco_saved_kwh')}, {r('eco_saved_pct')}, {r('p_sleep')}
FROM units u ORDER BY u.{by} {direction} NULLS LAST, bs LIMIT {count}""")


for _by, _count, _ascending in (
    ("eco_saved_kwh", 10, False),
    ("eco_saved_pct", 5, True),
    ("baseline_kwh", 10, False),
    ("traffic_gib", 20, False),
    ("p_sleep", 10, True),
):

    @query(f"top_by_{_by}", _top_sql(_by, _count, "ASC" if _ascending else "DESC"))
    def top_stations(spark, sf_dir, by=_by, count=_count, ascending=_ascending):
        return kpis.top_stations(kpis.bs_summary(policy(spark, sf_dir)), by, count, ascending)


@query("top25_traffic", sql(PREP, f"""
SELECT bs, {r('t', 'traffic_kbyte')} FROM (SELECT bs, sum(traffic_kb) AS t FROM prep GROUP BY bs ORDER BY t DESC, bs LIMIT 25)"""))
def top25_traffic(spark, sf_dir):
    return kpis.busiest_stations(prepared(spark, sf_dir))


@query("station_scatter", sql(pol_plain(), _bs_sql(), _UNITS, f"SELECT bs, {r('mean_prb')}, {r('eco_saved_pct')} FROM units"))
def station_scatter(spark, sf_dir):
    summary = kpis.ranked_units(kpis.bs_summary(policy(spark, sf_dir)))
    return reports.scatter_points(summary, "mean_prb", "eco_saved_pct", ["bs"])


# -- sweep ---------------------------------------------------------------------------

_GRID = [(t, max(0.0, t - 0.1)) for t in sweep.even_grid()]
_FLAT = [(t, t) for t in sweep.even_grid(0.0, 1.0, 11)]
_SAMPLED = """
cells AS (SELECT bs, cell, row_number() OVER (ORDER BY md5('42|' || bs || '||' || cell)) AS rk
          FROM (SELECT DISTINCT bs, cell FROM prep)),
sampled AS (SELECT sc.* FROM sc JOIN cells USING (bs, cell)
            WHERE rk <= greatest(1, cast(floor((SELECT count(*) FROM cells) * 0.2) AS bigint)))"""
_SWEPT = f"""
swept AS (
  SELECT tau_on, sum(eco_saved_wh) / 1000 AS saved_kwh,
         100.0 * count(*) FILTER (state = 'ECO' AND prb > 20) / count(prb) AS risk_pct,
         100.0 * count(*) FILTER (state = 'ECO' AND prb IS NOT NULL) / count(*) AS eco_coverage_pct
  FROM pol GROUP BY tau_on)"""
_SWEEP_OUT = f"SELECT {r('tau_on')}, {r('saved_kwh')}, {r('risk_pct')}, {r('eco_coverage_pct')} FROM swept"


@query("pareto_sweep", sql(score_sql(), pol_probability(_GRID), _SWEPT, _SWEEP_OUT))
def pareto_sweep(spark, sf_dir):
    return sweep.pareto_sweep(scored(spark, sf_dir), ALPHA)


@query("pareto_sweep_sampled", sql(score_sql(), _SAMPLED, pol_probability(_GRID, "sampled"), _SWEPT, _SWEEP_OUT))
def pareto_sweep_sampled(spark, sf_dir):
    """A fifth of the cells, for a first look."""
    return sweep.pareto_sweep(scored(spark, sf_dir), ALPHA, sample_fraction=0.20)


@query("pareto_sweep_one_level", sql(score_sql(True), pol_probability(_FLAT), _SWEPT, _SWEEP_OUT))
def pareto_sweep_flat(spark, sf_dir):
    """No gap between the levels, every cell: scores on a level swap the state."""
    grid = [on for on, _ in _FLAT]
    return sweep.pareto_sweep(scored(spark, sf_dir, tenths=True), ALPHA, grid, offset=0.0, sample_fraction=1.0)


@query("recommend_tau", sql(score_sql(), pol_probability(_GRID), _SWEPT, f"""
{_SWEEP_OUT} WHERE risk_pct <= 1.0 ORDER BY swept.saved_kwh DESC, swept.tau_on LIMIT 1"""))
def recommend_tau(spark, sf_dir):
    return sweep.recommended_level(sweep.pareto_sweep(scored(spark, sf_dir), ALPHA))


@query("safe_levels", sql(score_sql(), pol_probability(_GRID), _SWEPT, f"""
{_SWEEP_OUT} WHERE risk_pct <= 5.0"""))
def safe_levels(spark, sf_dir):
    return sweep.safe_levels(sweep.pareto_sweep(scored(spark, sf_dir), ALPHA), 5.0)


# -- drift and histograms ---------------------------------------------------------------

_BOTH = """
both_sides AS (
  SELECT 'reference' AS dataset, prb, users, traffic_kb / (1024.0 * 1024.0) AS traffic_gib FROM prep
  WHERE date_diff('day', DATE '2024-01-01', d) % 7 < 5
  UNION ALL
  SELECT 'current', prb, users, traffic_kb / (1024.0 * 1024.0) FROM prep
  WHERE date_diff('day', DATE '2024-01-01', d) % 7 >= 5)"""


def _sides(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    return rows.filter(is_weekday()), rows.filter(~is_weekday())


_MEASURES = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
_DRIFT_OUT = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{m}' AS metric, "
    + r(f"(SELECT {fn}({f}) FROM both_sides WHERE dataset = 'reference')", "reference")
    + ", "
    + r(f"(SELECT {fn}({f}) FROM both_sides WHERE dataset = 'current')", "current")
    for f in drift.FEATURES
    for m, fn in _MEASURES.items()
)


@query("drift_stats", sql(PREP, _BOTH, _DRIFT_OUT))
def drift_stats(spark, sf_dir):
    return drift.drift_table(*_sides(spark, sf_dir))


def _step_sql(source: str, column: str, max_bins: int) -> str:
    return f"""
step AS (
  SELECT s FROM (SELECT cast(m || 'e' || k AS double) AS s FROM unnest([1, 2, 5]) a(m), range(-12, 19) b(k)),
                (SELECT max({column}) - min({column}) AS span FROM {source})
  WHERE span / s <= {max_bins} ORDER BY s LIMIT 1)"""


for _feature in drift.FEATURES:

    @query(f"drift_hist_{_feature}", sql(PREP, _BOTH, _step_sql("both_sides", _feature, 40), f"""
SELECT dataset, {r('bin * s', 'bin_start')}, {n('count(*)', 'n')}
FROM (SELECT dataset, s, floor({_feature} / s) AS bin FROM both_sides, step) GROUP BY dataset, bin, s"""))
    def drift_hist(spark, sf_dir, feature=_feature):
        return drift.drift_histogram(*_sides(spark, sf_dir), feature)


for _column, _width in reports.CELL_BINS.items():

    @query(f"hist_cells_{_column}", sql(pol_plain(), _cell_sql(), f"""
SELECT {r(f'bin * {_width}', 'bin_start')}, {n('count(*)', 'n')}
FROM (SELECT floor({_column} / {_width}::double) AS bin FROM cell_kpi) GROUP BY bin"""))
    def hist_cells(spark, sf_dir, column=_column, width=_width):
        return drift.histogram(kpis.cell_kpis(policy(spark, sf_dir)), column, width)


@query("hist_stations_saved", sql(pol_plain(), _bs_sql(), _UNITS, _step_sql("units", "eco_saved_kwh", 30), f"""
SELECT {r('bin * s', 'bin_start')}, {n('count(*)', 'n')}
FROM (SELECT s, floor(eco_saved_kwh / s) AS bin FROM units, step) GROUP BY bin, s"""))
def hist_stations(spark, sf_dir):
    return drift.histogram(kpis.with_kwh(kpis.bs_summary(policy(spark, sf_dir))), "eco_saved_kwh")


@query("hist_load", sql(PREP, _step_sql("prep", "prb", 30), f"""
SELECT {r('bin * s', 'bin_start')}, {n('count(*)', 'n')} FROM (SELECT s, floor(prb / s) AS bin FROM prep, step) GROUP BY bin, s"""))
def hist_load(spark, sf_dir):
    return drift.histogram(prepared(spark, sf_dir), "prb")
