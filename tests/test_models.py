import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattcell.ml import studies
from wattcell.ml.features import FeatureSpec, TRANSFER, feature_columns, label
from wattcell.ml.model import BOOSTED, ISOTONIC, LOGISTIC, SIGMOID, TrainSpec, fit_sleep_model, load_bundle, save_bundle
from wattcell.ml.split import CELL_GROUPS, LAST_DAYS, DegenerateSplit, SplitSpec, adaptive_split, group_holdout, last_days_holdout
from wattcell.operators.prepare import prepare
from wattcell.registry.models import ablation
from wattcell.schema import CELL
from wattcell.sources.adapters import events_telemetry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def prepared(spark):
    df = prepare(events_telemetry(spark, SF)).persist()
    yield df
    df.unpersist()


def test_feature_order(prepared):
    assert list(feature_columns(prepared)) == [
        "prb", "traffic_kb", "users", "bbu_w", "rru_w", "tod_bin", "tod_sin", "tod_cos", "traffic_mb", "prev_traffic_mb", "prev_users",
    ]
    assert list(feature_columns(prepared, studies.VARIANTS["load_only"])) == ["prb", "traffic_kb", "users", "traffic_mb"]
    bare = prepared.drop("tod_bin", "traffic_mb", "prev_users")
    row = bare.select(*[e.alias(c) for c, e in feature_columns(bare).items()]).first()
    assert row.tod_sin is None and row.prev_users is None and "traffic_mb" not in row.asDict()
    with pytest.raises(ValueError):
        feature_columns(prepared.drop("bbu_w"), TRANSFER)
    with pytest.raises(ValueError):
        label(prepared.drop("sleep_on"))


def test_splits(prepared):
    days = last_days_holdout(prepared, SplitSpec(test_days=2))
    last = {(r.bs, r.cell): r.m for r in prepared.groupBy(*CELL).agg(F.max("day_index").alias("m")).collect()}
    for r in days.select(*CELL, "day_index", "is_test").collect():
        assert r.is_test == (r.day_index >= last[(r.bs, r.cell)] - 1)
    cells = group_holdout(prepared)
    sides = cells.groupBy(*CELL).agg(F.countDistinct("is_test").alias("n"), F.bool_or("is_test").alias("t")).collect()
    assert all(r.n == 1 for r in sides) and sum(r.t for r in sides) == 3  # ceil(0.2 * 15)
    assert adaptive_split(prepared)[1] == LAST_DAYS
    one_day = prepared.withColumn("day_index", F.lit(0))
    assert adaptive_split(one_day)[1] == CELL_GROUPS
    with pytest.raises(DegenerateSplit):
        last_days_holdout(one_day)
    with pytest.raises(DegenerateSplit):
        group_holdout(prepared.filter("bs = 'B_0'"), ["bs"])


@pytest.mark.parametrize(
    "spec",
    [
        TrainSpec(model_type=BOOSTED, rounds=3, depth=3, rate=0.3, features=TRANSFER),
        TrainSpec(model_type=LOGISTIC, method=SIGMOID, logistic_iterations=10),
    ],
    ids=["boosted-isotonic", "logistic-sigmoid"],
)
def test_train_store_score(spark, prepared, tmp_path, spec):
    model, report = studies.train_report(prepared, spec)
    assert report["split"]["train_rows"] + report["split"]["test_rows"] == report["split"]["n_rows"] == 1000
    assert report["test_metrics"]["auroc"] > 0.8 and report["features"] == model.names
    paths = save_bundle(spark, model, report, str(tmp_path))
    loaded = load_bundle(spark, paths["model_path"], spec.features)
    first = model.score(prepared).select("seq", "p_sleep_on")
    assert first.exceptAll(loaded.score(prepared).select("seq", "p_sleep_on")).isEmpty()
    assert first.filter("p_sleep_on between 0 and 1").count() == 1000
    with pytest.raises(ValueError, match="trained on"):
        load_bundle(spark, paths["model_path"], FeatureSpec(time=False))
    assert studies.evaluation_report(loaded, prepared, studies.EvalSpec(spec.features))["n_rows"] == 1000


def test_plain_model_and_studies(spark, prepared):
    spec = TrainSpec(model_type=LOGISTIC, calibrate=False, logistic_iterations=5, features=TRANSFER)
    model = fit_sleep_model(prepared, spec)
    report = studies.sanity_report(prepared, model, spec)
    checks = report["sanity_checks"]
    assert checks["prb_threshold_baseline"]["t"] <= 25.5 and checks["calibration_deciles_on_cell_holdout_test"]["ok"]
    assert checks["duplicate_daily_profile_check"]["n_cells"] == 15
    table = studies.ablation_table(prepared, spec, {k: studies.VARIANTS[k] for k in ("full", "load_only")})
    assert table.count() == 2
    profiles, summary = studies.transfer_profiles(model, {"weekday": prepared})
    assert profiles["weekday"].count() == 48 and 0 < summary["weekday"]["p_sleep_on_mean"] < 1


def test_unknown_kinds(prepared):
    with pytest.raises(ValueError, match="model type"):
        fit_sleep_model(prepared, TrainSpec(model_type="forest"))
    with pytest.raises(FileNotFoundError):
        load_bundle(prepared.sparkSession, "/nowhere/model")


def test_ablation_derives_the_rows_once(prepared, monkeypatch):
    seen = []
    monkeypatch.setattr(studies, "station_holdout_report", lambda df, spec: seen.append(df) or {})
    ordered = prepared.withColumn("place", F.row_number().over(Window.partitionBy("bs", "cell").orderBy("seq")))
    assert list(studies.ablation_report(ordered)["ablations"]) == list(studies.VARIANTS)
    assert len(seen) == 5 and not any("Window" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_ablation_query_trains_in_full(spark, monkeypatch):
    seen = []
    found = {"test_metrics": dict.fromkeys(studies.METRICS, 0.5), "test_label_prevalence": 0.5}
    monkeypatch.setattr(studies, "station_holdout_report", lambda df, spec: seen.append(spec) or found)
    assert ablation(spark, SF).count() == 5
    assert sorted(map(repr, seen)) == sorted(repr(TrainSpec(features=f)) for f in studies.VARIANTS.values())
    assert all((s.model_type, s.rounds, s.depth, s.method, s.folds) == (BOOSTED, 300, 6, ISOTONIC, 3) for s in seen)
