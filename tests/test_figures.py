import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import wattcell.operators.metrics as metrics
import wattcell.operators.ordered as ordered
from helpers import auroc, average_precision, linear_quantile, rows, series
from wattcell.functions import columns as fx
from wattcell.operators import drift, kpis, profiles, sampling, sweep
from wattcell.operators.policy import hysteresis_states, load_policy, probability_policy
from wattcell.operators.prepare import prepare
from wattcell.operators.quantiles import medians, quantile_row, quantiles
from wattcell.operators.thresholds import attach_thresholds, series_thresholds, threshold_table, with_thresholds
from wattcell.plans import reports
from wattcell.plans.policies import LEARNED, PolicySpec, policy_table, view
from wattcell.schema import CELL


# -- quantiles and thresholds -----------------------------------------------------------


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_quantiles(spark, ranges):
    rng = random.Random(7)
    groups = {"a": [rng.gauss(0, 10) for _ in range(900)], "b": [float(rng.randint(0, 3)) for _ in range(500)], "c": [5.0], None: [1.0, 2.0]}
    out = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(out, "k string, x double")
    probs = [0.0, 0.1, 0.3, 0.301, 0.7, 1.0]
    got = {r.k: r for r in quantiles(df, ["k"], "x", probs, ranges).collect()}
    assert set(got) == {"a", "b", "c", None, "d"} and got["d"].n == 0 and got["d"].q is None
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        assert got[k].q == pytest.approx([linear_quantile(vs, q) for q in probs], abs=1e-9)


def test_quantiles_of_a_whole_column(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    assert quantile_row(df, "x", [0.25, 0.5]) == pytest.approx([249.75, 499.5])
    assert medians(df.withColumn("z", F.lit(None).cast("double")), ["x", "y", "z"]) == pytest.approx({"x": 499.5, "y": 1.0, "z": None})
    assert quantile_row(df.limit(0), "x", [0.5]) is None and medians(df.limit(0), ["x"]) == {"x": None}
    assert quantiles(df.limit(0), ["y"], "x", [0.5]).isEmpty()


def test_quantiles_of_extreme_values(spark):
    """One value holds most rows, magnitudes differ widely, both zeros are one value."""
    values = [0.0] * 600 + [-0.0] * 100 + [-1e308, 1e308, 5e-324, float("inf"), float("-inf")] + [float(i) for i in range(1, 200)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    probs = [0.0, 0.001, 0.2, 0.7, 0.9, 1.0]
    got = quantiles(df, [], "x", probs, ranges=30).first()
    assert got.n == len(values)
    ordered_values = sorted(values)
    for p, found in zip(probs, got.q):
        place = p * (len(values) - 1)
        low, high = ordered_values[math.floor(place)], ordered_values[math.ceil(place)]
        assert low <= found <= high


def test_quantile_windows_stay_inside_ranges(spark):
    """A column without keys is never ordered by value in one window."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = quantiles(df, [], "x", [0.5], ranges=20)._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Window" in line and "[_v" in line]
    assert by_value and all("_range" in line.split("[_v")[0] for line in by_value)


def test_min_sample_and_null_key(spark):
    nine = [("b", None, 1, float(i)) for i in range(9)]
    ten = [("b", "c", 1, float(i)) for i in range(10)]
    df = spark.createDataFrame(nine + ten, "bs string, cell string, tod_bin int, prb double")
    table = threshold_table(df, "Per-Cell")
    got = {r.cell: (r.p30, r.p70) for r in table.collect()}
    assert got[None] == (None, None) and got["c"] == pytest.approx((2.7, 6.3))
    full = threshold_table(df, "Per-Cell", min_n=1)
    joined = attach_thresholds(df, full, "Per-Cell")
    assert joined.count() == 19 and joined.filter("p30 is null").isEmpty()
    with pytest.raises(PySparkException, match="several"):
        attach_thresholds(df, full.unionByName(full), "Per-Cell").collect()
    with pytest.raises(ValueError, match="scope"):
        threshold_table(df, "Per-Planet")


def test_global_fallback(spark):
    df = prepare(rows(spark, [float(i) for i in range(20)]))
    got = with_thresholds(df, "Global").select("p30", "p70").distinct().collect()
    assert [tuple(r) for r in got] == [pytest.approx((5.7, 13.3))]
    few = with_thresholds(prepare(rows(spark, [1.0, 2.0])), "Global").first()
    assert few.p30 is None and few.p70 is None
    table = threshold_table(df, "Global", min_n=1)
    assert with_thresholds(df, "Global", table).filter("p30 = prb").count() == 20
    again = load_policy(load_policy(df, thresholds=table), thresholds=table)
    assert again.columns.count("p30") == 1
    assert series_thresholds(df.limit(0)).first().p30 is None


# -- states -----------------------------------------------------------------------------


def test_hysteresis_examples(spark):
    loads = [70.0, 57.0, 61.0, 63.0, 17.0, 21.0, 23.0, None, 59.0]
    df = prepare(rows(spark, loads)).withColumns({"p30": F.lit(20.0), "p70": F.lit(60.0)})
    got = [r.state for r in hysteresis_states(df).orderBy("seq").collect()]
    assert got == ["FULL", "ECO", "ECO", "FULL", "SLEEP", "SLEEP", "ECO", "UNKNOWN", "ECO"]
    df = prepare(rows(spark, [21.0, 22.0, 23.0])).withColumns({"p30": F.lit(20.0), "p70": F.lit(20.0)})
    assert [r.state for r in hysteresis_states(df, 5.0, 0.0).orderBy("seq").collect()] == ["ECO", "FULL", "ECO"]


def test_energy(spark):
    df = prepare(rows(spark, [1.0, 50.0, 90.0])).withColumn("rru_w", F.when(F.col("seq") < 2, 100.0))
    df = df.withColumns({"p30": F.lit(10.0), "p70": F.lit(60.0)})
    table = df.select("tod_bin", "p30", "p70")
    got = load_policy(df, alpha=0.4, hysteresis=False, thresholds=table).orderBy("seq").collect()
    assert [(r.state, r.baseline_wh, r.eco_saved_wh) for r in got] == [("SLEEP", 50.0, 0.0), ("ECO", 50.0, 20.0), ("FULL", 0.0, 0.0)]


def test_policy_dispatch(spark):
    df = prepare(rows(spark, [10.0, 90.0]))
    with pytest.raises(ValueError, match="controller"):
        policy_table(df, PolicySpec(controller="Magic"))
    with pytest.raises(ValueError, match="model"):
        policy_table(df, PolicySpec(controller=LEARNED))
    scored = df.withColumn("p_sleep_on", F.lit(0.9))
    got = policy_table(scored, PolicySpec(controller=LEARNED, alpha=0.5))
    assert {r.state for r in got.collect()} == {"ECO"} and {"p30", "p70"} <= set(got.columns)


def test_risk_of_empty_view(spark):
    df = probability_policy(prepare(rows(spark, [10.0, 90.0])).withColumn("p_sleep_on", F.lit(0.9)))
    empty = kpis.risk_metrics(view(df, 40)).first().asDict()
    assert empty == {"risk_intervals": 0, "risk_percent_total": 0.0, "risk_percent_eco": 0.0, "eco_intervals": 0}
    got = kpis.risk_metrics(df).first()
    assert (got.risk_intervals, got.risk_percent_total, got.eco_intervals) == (1, 50.0, 2)
    assert kpis.bs_confusion(df.drop("state")).first().asDict() == {"tp": 0, "fp": 0, "fn": 0, "tn": 0}


def test_invariants(spark):
    df, out = series(spark, seed=8, nulls=0.0)
    df = df.withColumns({"rru_w": F.col("prb") + 1, "traffic_kb": F.lit(1.0), "users": F.lit(1.0), "sleep_frac": F.lit(0.0)})
    pol = load_policy(df, "Global", alpha=0.3)
    s = pol.agg(F.sum("eco_saved_wh").alias("s"), F.sum("baseline_wh").alias("b"), F.count(F.lit(1)).alias("n")).first()
    assert s.n == len(out) and 0 <= s.s <= 0.3 * s.b
    shares = kpis.state_distribution(pol).collect()
    assert sum(r.percent for r in shares) == pytest.approx(100.0)
    assert [r.percent for r in shares] == sorted((r.percent for r in shares), reverse=True)
    c = kpis.bs_confusion(pol, "ECO").first()
    assert c.tp + c.fp + c.fn + c.tn == 3


# -- score quality ----------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [None, 7])
@pytest.mark.parametrize("digits", [1, 9])
def test_rank_metrics(spark, ranges, digits):
    rng = random.Random(digits)
    pairs = [(int(rng.random() < 0.3), round(rng.random(), digits)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y int, p double")
    got = metrics.binary_metrics(df, ranges=ranges).first()
    clipped = [(y, min(max(p, 1e-6), 1 - 1e-6)) for y, p in pairs]
    mean = sum(p for _, p in clipped) / 300
    assert got.auroc == pytest.approx(auroc(clipped)) and got.auprc == pytest.approx(average_precision(clipped))
    assert got.brier == pytest.approx(sum((p - y) ** 2 for y, p in clipped) / 300)
    assert got.p_mean == pytest.approx(mean)
    assert got.p_std == pytest.approx(math.sqrt(sum((p - mean) ** 2 for _, p in clipped) / 300))
    assert (got.tp, got.fp) == (sum(y for y, p in clipped if p >= 0.5), sum(1 - y for y, p in clipped if p >= 0.5))
    assert got.n_rows == 300 and got.tp + got.fp + got.fn + got.tn == 300


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "y int, p double")
    got = metrics.binary_metrics(df).first()
    assert got.auroc is None and got.auprc is None and got.brier == pytest.approx(0.1)
    assert metrics.binary_metrics(df.limit(0)).first().n_rows == 0


@pytest.mark.parametrize("ranges", [None, 5])
def test_load_ranks(spark, ranges):
    rng = random.Random(11)
    data = [(rng.choice([0.0, 0.0, 0.0, rng.uniform(0, 100)]), rng.random() < 0.4, i) for i in range(200)]
    df = spark.createDataFrame([*data, (None, True, 200)], "prb double, sleep_on boolean, seq long")
    got = sorted(r.p for r in metrics.load_rank_scores(df, ranges=ranges).collect())
    assert got == pytest.approx([i / 199 for i in range(200)])
    order = sorted(data, key=lambda r: (r[0], r[2]))
    pairs = [(int(y), min(max(1 - i / 199, 1e-6), 1 - 1e-6)) for i, (_, y, _) in enumerate(order)]
    assert metrics.binary_metrics(metrics.load_rank_scores(df)).first().auroc == pytest.approx(auroc(pairs))


def test_best_threshold_tie(spark):
    """Every t above 10 and up to 20 separates perfectly: the smallest wins."""
    df = spark.createDataFrame([(10.0, True), (5.0, True), (20.0, False), (-1.0, True), (150.0, False)], "prb double, sleep_on boolean")
    got = metrics.best_load_threshold(df, df).first()
    assert (got.t, got.train_f1, got.tp, got.fp, got.fn, got.tn) == (10.5, 1.0, 3, 0, 0, 2)
    never = metrics.best_load_threshold(df.filter("not sleep_on"), df).first()
    assert (never.t, never.train_f1, never.fn) == (0.0, 0.0, 2) and never.tp == 1


def test_deciles(spark):
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(101)], "y int, p double")
    got = metrics.calibration_deciles(df).collect()
    assert [r.n for r in got] == [11] + [10] * 9 and got[0].bin == 0
    same = spark.createDataFrame([(0, 0.5)] * 30, "y int, p double")
    assert metrics.calibration_deciles(same).isEmpty()


def test_duplicate_profiles(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SEQ_BITS", 2)
    a = rows(spark, [1.001, 2.0, 3.0] * 9, cell="a")
    b = rows(spark, [1.004, 2.0, 3.0] * 9, cell="b")
    c = rows(spark, [1.006, 2.0, 3.0] * 9, cell="c")
    short = rows(spark, [1.001, 2.0], cell="d")
    df = prepare(a.unionByName(b).unionByName(c).unionByName(short))
    for marked in (df, ordered.mark_hot_cells(df, 5)):
        got = profiles.duplicate_profiles(marked).first()
        assert (got.ok, got.n_cells, got.n_unique_profiles, got.max_duplicate_count) == (True, 4, 3, 2)
        assert got.frac_cells_in_duplicate_groups == 0.5
    assert profiles.duplicate_profiles(df.limit(0)).first().ok is False


# -- samples, sweep, drift, reports ----------------------------------------------------


def test_sampling(spark):
    df = spark.range(2000).select(
        F.format_string("b%d", F.col("id") % 50).alias("bs"), F.format_string("c%d", F.col("id") % 100).alias("cell"), F.col("id").alias("seq")
    )
    got = sampling.sample_cells(df, 0.2)
    assert got.select(*CELL).distinct().count() == 20 and got.count() == 20 * 20
    assert sampling.sample_cells(df, 0.001).count() == 20
    assert sampling.sample_cells(df, 1.0).count() == 2000
    assert sampling.sample_cells(df.limit(0), 0.5).isEmpty()
    cutoffs = [sampling.hash_cutoff(df, CELL, 7, lambda _, k=k: k) for k in (0, 1, 50, 100, 101)]
    assert [c[0] for c in cutoffs] == sorted(c[0] for c in cutoffs)
    assert [c[1:] for c in cutoffs] == [(0, 100), (1, 100), (50, 100), (100, 100), (100, 100)]
    assert sampling.downsample(df, F.col("seq"), 10).count() == 10


def test_sweep(spark):
    df, _ = series(spark, seed=6)
    df = df.withColumns({"rru_w": F.lit(100.0), "p_sleep_on": F.round(1 - F.col("prb") / 100, 2)})
    got = sweep.pareto_sweep(df, 0.5, [0.0, 0.5, 0.9], 0.1, sample_fraction=1.0).orderBy("tau_on").collect()
    for r in got:
        one = probability_policy(df, sweep.ProbabilityController(r.tau_on, max(0.0, r.tau_on - 0.1)), 0.5)
        risk = kpis.risk_metrics(one).first()
        assert r.risk_pct == pytest.approx(risk.risk_percent_total)
        assert r.saved_kwh == pytest.approx(one.agg(F.sum("eco_saved_wh")).first()[0] / 1000)
    levels = spark.createDataFrame([(0.1, 9.0, 5.0), (0.5, 7.0, 1.0), (0.7, 7.0, 0.5)], "tau_on double, saved_kwh double, risk_pct double")
    assert sweep.recommended_level(levels).first().tau_on == 0.5
    assert sweep.recommended_level(levels, 0.1).isEmpty()
    assert sweep.even_grid(0.0, 1.0, 3) == [0.0, 0.5, 1.0] and len(sweep.even_grid()) == 15


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.99, 1.0, None, float("nan"))], "x double")
    got = {round(r.bin_start, 6): r.n for r in drift.histogram(df, "x", 0.5).collect()}
    assert got == {0.0: 2, 0.5: 1, 1.0: 1}
    assert drift.round_step(100, 30) == 5.0 and drift.round_step(100, 40) == 5.0 and drift.round_step(1, 30) == 0.05
    assert drift.histogram(df.limit(0), "x").isEmpty()


def test_display_and_tiers(spark):
    df = spark.createDataFrame([(999.0, 1024.0 * 1024), (2e6, 2.0 * 1024**3)], "wh double, kb double")
    got = df.select(fx.energy_display(F.col("wh")).alias("e"), fx.traffic_display(F.col("kb")).alias("t")).collect()
    assert [tuple(r.e) for r in got] == [("0.999", "kWh"), ("2.000", "MWh")]
    assert [tuple(r.t) for r in got] == [("1.000", "GiB"), ("2.000", "TiB")]
    loads = spark.createDataFrame([(x,) for x in (10.0, 20.0, 50.0, 80.0)], "x double")
    tiers = kpis.with_tiers(loads, "x", installed=2).orderBy("x").collect()
    assert [r.tier for r in tiers] == ["SLEEP", "ECO", "FULL", "FULL"] and [r.receivers for r in tiers] == [1, 2, 2, 2]
    assert kpis.fleet_energy(kpis.with_tiers(loads, "x")).first()[0] == pytest.approx(2.8)
    assert loads.select(fx.cell_label(F.lit("b"), F.lit("c")).alias("l")).first().l == "b||c"


def test_reports(spark):
    df, _ = series(spark, seed=2, nulls=0.0)
    df = df.withColumns(
        {"rru_w": F.lit(100.0), "traffic_kb": F.lit(2048.0), "users": F.lit(1.0), "sleep_frac": F.lit(0.1), "p_sleep_on": 1 - F.col("prb") / 100}
    )
    plain = policy_table(df.drop("p_sleep_on"), PolicySpec())
    got = reports.overview_report(plain, PolicySpec(), "d", "w")
    assert got["base_stations"] == 3 and set(got["heuristic_vs_gt_bs_level"]) == {"tp", "fp", "fn", "tn"}
    spec = PolicySpec(controller=LEARNED)
    learned = policy_table(df, spec)
    got = reports.overview_report(learned, spec)
    assert set(got["p_sleep_on"]) == {"p_mean", "p_std", "p90", "p99"} and "eco_vs_gt_sleep_bs_level" in got
    risk = reports.risk_report(learned, grid=[0.2, 0.95], sample_fraction=1.0)
    assert len(risk["sweep"]) == 2 and risk["over_limit"] == (risk["risk"]["risk_percent_total"] > 1.0)
    drill = reports.drilldown_report(plain)
    assert drill["cells"].count() == drill["saving_bars"].count() and drill["sleep_bars"].count() == 2 * drill["cells"].count()
    assert reports.drilldown_report(plain.limit(0))["busiest"] == []
    spread = reports.heterogeneity_report(plain)
    assert spread["n_cells"] == 7 and sum(r.n for r in spread["cells"]["p_sleep"].collect()) == 7
    shift = reports.drift_report(df.filter("day_index = 0"), df, "users")
    assert shift["table"].count() == 12 and sum(r.n for r in shift["histogram"].collect()) > df.count()
    top = kpis.top_stations(kpis.bs_summary(plain), "traffic_gib", 2)
    assert [r["rank"] for r in top.collect()] == [1, 2] and reports.top_scatter(top).count() == 2
    with pytest.raises(ValueError):
        kpis.top_stations(kpis.bs_summary(plain), "height")
    with pytest.raises(ValueError):
        reports.state_bars(df)
