import random

import pytest
from pyspark.sql import functions as F

import wattcell.operators.ordered as ordered
from helpers import by_day, load_machine, rows, score_machine, series
from wattcell.operators.kpis import cell_kpis, mark_bouts
from wattcell.operators.ordered import HOT, Running, mark_hot_cells, running, running_per_cell
from wattcell.operators.policy import ProbabilityController, hysteresis_states, probability_states
from wattcell.operators.prepare import prepare


@pytest.fixture(params=["plain", "split"])
def cut(request, monkeypatch):
    """Runs a test with plain windows, and with the large cells cut into tiny blocks."""
    if request.param == "plain":
        return lambda df: df
    monkeypatch.setattr(ordered, "SEQ_BITS", 2)
    return lambda df: mark_hot_cells(df, 30)


def test_hot_cells_are_found(spark):
    df, out = series(spark)
    hot = mark_hot_cells(df, 30).filter(HOT).select("bs", "cell").distinct().collect()
    sizes = {}
    for r in out:
        sizes[r[:2]] = sizes.get(r[:2], 0) + 1
    assert {tuple(r) for r in hot} == {k for k, n in sizes.items() if n > 30}
    assert HOT not in mark_hot_cells(df, 10**6).columns


@pytest.mark.parametrize("hs,he", [(2.0, 2.0), (0.0, 0.0), (5.0, 0.0), (20.0, 3.0), (3.0, 20.0)])
def test_load_hysteresis(spark, cut, hs, he):
    """Includes margins that give the band in which FULL and ECO change places."""
    df, out = series(spark, seed=int(hs * 7 + he))
    got = {r.seq: r.state for r in hysteresis_states(cut(df), hs, he).select("seq", "state").collect()}
    want = {}
    for group in by_day(out).values():
        want.update(load_machine(group, hs, he))
    assert got == want


def test_load_hysteresis_null_keys(spark, cut):
    df, out = series(spark, seed=9)
    blank = cut(df.withColumn("bs", F.lit(None).cast("string")))
    got = {r.seq: r.state for r in hysteresis_states(blank).select("seq", "state").collect()}
    want = {}
    for group in by_day([(None, *r[1:]) for r in out]).values():
        want.update(load_machine(group, 2.0, 2.0))
    assert got == want


def test_negative_margin(spark):
    df, _ = series(spark)
    with pytest.raises(ValueError):
        hysteresis_states(df, -1.0, 0.0)


def test_probability_hysteresis(spark, cut):
    df, out = series(spark, seed=5)
    score = lambda load: None if load is None else round(1 - load / 100, 1)
    tenth = F.round(1 - F.col("prb") / 100, 1)
    known = {load: score(load) for load in {r[4] for r in out} if load is not None}
    # The machine sees the very scores Spark rounded.
    df = df.withColumn("p_sleep_on", tenth)
    seen = {r.prb: r.p_sleep_on for r in df.select("prb", "p_sleep_on").distinct().collect()}
    assert set(known) <= set(seen)
    levels = {
        "a": ProbabilityController(0.8, 0.7),
        "b": ProbabilityController(0.5, 0.9),
        "c": ProbabilityController(0.6, 0.2, hysteresis=False),
        "d": ProbabilityController(0.0, 0.0),
    }
    assert levels["b"].exit_level == 0.5 and levels["c"].exit_level == 0.6
    got = probability_states(cut(df), levels).select("seq", *levels).collect()
    for name, c in levels.items():
        want = {}
        for group in by_day(out).values():
            want.update(score_machine(group, c.tau_on, c.exit_level, seen.get))
        assert {r.seq: r[name] for r in got} == want, name


def test_bouts_and_cell_kpis(spark, cut):
    df, out = series(spark, seed=3)
    df = cut(df).withColumns({c: F.lit(1.0) for c in ("rru_w", "baseline_wh", "eco_saved_wh", "sleep_frac")})
    cells = {}
    for r in out:
        cells.setdefault(r[:2], []).append(r)
    starts, numbers, kpi = {}, {}, {}
    for key, group in cells.items():
        was, bouts = False, 0
        for r in sorted(group, key=lambda r: (r[2], r[3], r[8])):
            starts[r[8]] = r[7] and not was
            bouts += starts[r[8]]
            numbers[r[8]] = bouts if r[7] else 0
            was = r[7]
        asleep = sum(r[7] for r in group)
        kpi[key] = (len(group), len({r[2] for r in group}), bouts, asleep / bouts if bouts else 0.0)
    marked = mark_bouts(df).select("seq", "bout_start", "bout_id").collect()
    assert {r.seq: r.bout_start for r in marked} == starts
    assert {r.seq: r.bout_id for r in marked} == numbers
    got = cell_kpis(df).collect()
    assert {(r.bs, r.cell): (r.n_rows, r.n_days, r.n_bouts, r.mean_bout_intervals) for r in got} == kpi


def test_bout_example(spark):
    df = prepare(rows(spark, [1.0] * 4, ds=[5, 5, 0, 5])).withColumns(
        {"baseline_wh": F.lit(0.0), "eco_saved_wh": F.lit(0.0)}
    )
    got = cell_kpis(df).first()
    assert (got.n_bouts, got.mean_bout_intervals, got.mean_bout_minutes) == (2, 1.5, 45.0)
    assert got.eco_saved_pct_of_baseline == 0.0


@pytest.mark.parametrize("mode", ["date", "sequence", "reference"])
def test_prepare_split_equals_plain(spark, monkeypatch, mode):
    monkeypatch.setattr(ordered, "SEQ_BITS", 2)
    rng = random.Random(4)
    out = []
    for i in range(400):
        cell = "hot" if rng.random() < 0.5 else f"c{rng.randint(0, 5)}"
        day, minute = rng.randint(1, 3), rng.randint(0, 1439)
        users = None if rng.random() < 0.2 else float(rng.randint(0, 9))
        out.append(("b", cell, f"2024-01-0{day} {minute // 60:02d}:{minute % 60:02d}:00", 1.0, float(i), users, i))
    df = spark.createDataFrame(out, "bs string, cell string, t string, prb double, traffic_kb double, users double, seq long")
    df = df.withColumn("ts", F.to_timestamp_ntz("t")).drop("t")
    plain = prepare(df, mode)
    split = prepare(df, mode, hot_cell_rows=20)
    assert HOT in split.columns
    wanted = ["seq", "prev_traffic_mb", "prev_users", "day_index"]
    assert split.select(wanted).exceptAll(plain.select(wanted)).isEmpty()
    assert split.count() == plain.count()


def test_day_modes(spark):
    df = rows(spark, [1.0, 2.0, 3.0, 4.0], minutes=600)  # 00:00, 10:00, 20:00, 06:00 of the next day
    got = [(r.day_index, r.prev_traffic_mb) for r in prepare(df, "sequence").orderBy("seq").collect()]
    assert [d for d, _ in got] == [0, 0, 0, 1]
    assert [p for _, p in got] == [None, 1.0, 1.0, 1.0]
    assert {r.day_index for r in prepare(df).collect()} == {0}
    with pytest.raises(ValueError):
        prepare(df, "weekly")


def test_running_three_levels(spark):
    """Blocks inside blocks inside a series, against one plain window."""
    rng = random.Random(2)
    out = [(i, rng.randint(0, 4), None if rng.random() < 0.5 else i) for i in range(300)]
    df = spark.createDataFrame(out, "at long, x long, maybe long")
    cols = [
        Running("total", F.col("x"), "sum"),
        Running("before", F.col("x"), "sum", inclusive=False),
        Running("latest", F.col("maybe")),
        Running("previous", F.col("maybe"), "prev"),
    ]
    cut = df.withColumns({f"l{i}": F.expr(f"at div {s}") for i, s in enumerate((100, 20, 3))})
    got = running(cut, [], ["at"], cols, ["l0", "l1", "l2"]).drop("l0", "l1", "l2")
    want = running(df, [], ["at"], cols)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and got.count() == 300


def test_hot_series_run_the_plan_behind_them_once(spark):
    df, _ = series(spark)
    before = running_per_cell(mark_hot_cells(df, 30), ["bs", "cell"], ["seq"], [Running("_p", F.col("prb"), "prev")], F.lit(0))
    after = running_per_cell(before, ["bs", "cell"], ["seq"], [Running("_n", F.lit(1), "sum")], F.lit(0))
    assert "_n" in after.columns and "prev" not in after.columns
    assert after._jdf.queryExecution().optimizedPlan().toString().count("lag(") == 0
