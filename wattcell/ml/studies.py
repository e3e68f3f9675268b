"""Training reports, evaluations, ablations and sanity checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.ml.features import FeatureSpec, TRANSFER, label
from wattcell.ml.model import SleepModel, TrainSpec, fit_sleep_model
from wattcell.ml.split import CELL_GROUPS, STATION_GROUPS, SplitSpec, adaptive_split, group_holdout, split_report
from wattcell.operators import kpis
from wattcell.operators.metrics import (
    GRID_SIZE,
    GRID_STEP,
    best_load_threshold,
    binary_metrics,
    calibration_deciles,
    load_rank_scores,
)
from wattcell.operators.profiles import duplicate_profiles
from wattcell.schema import CELL, require_columns
from wattcell.session import materialize, side_by_side
from wattcell.sources.sinks import report_rows

METRICS = ("auroc", "auprc", "brier", "p_mean", "p_std")

# The feature groups compared by the ablation study.
VARIANTS = {
    "full": FeatureSpec(energy=True, prev=True, time=True, time_cyclical=True),
    "no_energy": FeatureSpec(energy=False, prev=True, time=True, time_cyclical=True),
    "no_time": FeatureSpec(energy=False, prev=True, time=False, time_cyclical=False),
    "no_prev": FeatureSpec(energy=False, prev=False, time=True, time_cyclical=True),
    "load_only": FeatureSpec(energy=False, prev=False, time=False, time_cyclical=False),
}


@dataclass(frozen=True)
class EvalSpec:
    features: FeatureSpec = field(default_factory=FeatureSpec)
    threshold: float = 0.5


def _labelled_scores(model: SleepModel, df: DataFrame) -> DataFrame:
    return model.score(df).select(label(df).alias("y"), F.col("p_sleep_on").alias("p"))


def evaluate(model: SleepModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of metrics of a model on the given rows."""
    require_columns(df, ["sleep_on"], "evaluate")
    return binary_metrics(_labelled_scores(model, df), "y", "p", threshold)


def evaluation_report(model: SleepModel, df: DataFrame, spec: EvalSpec = EvalSpec()) -> dict:
    if spec.features != model.features:
        raise ValueError(f"model was trained on {model.features}, not on {spec.features}")
    row = evaluate(model, df, spec.threshold).first().asDict()
    return {
        **{c: row[c] for c in ("n_rows", "label_prevalence", "auroc", "auprc", "brier", "threshold")},
        "confusion": {c: row[c] for c in ("tp", "fp", "fn", "tn")},
        "features_used": model.names,
        "prob_summary": {"mean": row["p_mean"], "std": row["p_std"]},
    }


def _test_metrics(model: SleepModel, test: DataFrame) -> tuple[dict, float]:
    row = evaluate(model, test).first().asDict()
    return {c: row[c] for c in METRICS}, row["label_prevalence"]


def train_report(df: DataFrame, spec: TrainSpec = TrainSpec()) -> tuple[SleepModel, dict]:
    """Split, fit on the training side, measure on the other."""
    split, strategy = adaptive_split(df, spec.split)
    model = fit_sleep_model(split.filter(~F.col("is_test")), spec)
    metrics, prevalence = _test_metrics(model, split.filter("is_test"))
    report = {
        "train_spec": asdict(spec),
        "split": split_report(split, strategy),
        "features": model.names,
        "test_metrics": metrics,
        "test_label_prevalence": prevalence,
    }
    return model, report


def station_holdout_report(
    df: DataFrame, spec: TrainSpec = TrainSpec(), fraction: float = 0.2, seed: int = 0
) -> dict:
    """Fit and measure with whole stations held out."""
    split = group_holdout(df, ["bs"], SplitSpec(test_fraction=fraction, seed=seed))
    model = fit_sleep_model(split.filter(~F.col("is_test")), spec)
    metrics, prevalence = _test_metrics(model, split.filter("is_test"))
    return {
        "split": split_report(split, STATION_GROUPS) | {"test_frac": fraction, "random_state": seed},
        "test_label_prevalence": prevalence,
        "test_metrics": metrics,
    }


def ablation_report(df: DataFrame, spec: TrainSpec = TrainSpec(), variants: dict[str, FeatureSpec] = VARIANTS) -> dict:
    df = materialize(df, "ablation")  # or every pass of every variant would derive the columns again
    summary = kpis.dataset_summary(df).first().asDict()

    def report(features: FeatureSpec) -> dict:
        return {"feature_spec": features.as_dict(), **station_holdout_report(df, replace(spec, features=features))}

    found = side_by_side(df.sparkSession, report, variants.values())
    return summary | {"ablations": dict(zip(variants, found, strict=True))}


def ablation_table(df: DataFrame, spec: TrainSpec = TrainSpec(), variants: dict[str, FeatureSpec] = VARIANTS) -> DataFrame:
    """One row per variant, best average precision first."""
    report = ablation_report(df, spec, variants)["ablations"]
    rows = [
        (name, *[r["test_metrics"][m] for m in METRICS], r["test_label_prevalence"]) for name, r in report.items()
    ]
    schema = "variant string, " + ", ".join(f"{m} double" for m in METRICS) + ", test_label_prevalence double"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc_nulls_last("auprc"), "variant")


def sanity_report(df: DataFrame, model: SleepModel, spec: TrainSpec = TrainSpec(features=TRANSFER)) -> dict:
    """Load-only baselines, holdouts, repeated profiles and calibration, in one document."""
    split = group_holdout(df, CELL)
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    load_only = binary_metrics(load_rank_scores(df)).first().asDict()
    chosen = best_load_threshold(train, test).first().asDict()
    metrics, prevalence = _test_metrics(model, test)
    deciles = report_rows(calibration_deciles(_labelled_scores(model, test)))
    return kpis.dataset_summary(df).first().asDict() | {
        "feature_spec_used_for_eval": model.features.as_dict(),
        "sanity_checks": {
            "prb_only_score_baseline": {
                "n_used": load_only["n_rows"],
                "label_prevalence": load_only["label_prevalence"],
                "metrics": {c: load_only[c] for c in METRICS},
            },
            "prb_threshold_baseline": chosen
            | {"threshold_grid": {"min": 0.0, "max": GRID_STEP * (GRID_SIZE - 1), "n": GRID_SIZE, "step": GRID_STEP}},
            "model_on_cell_holdout": {
                "split": split_report(split, CELL_GROUPS),
                "test_label_prevalence": prevalence,
                "test_metrics": metrics,
            },
            "base_station_holdout_eval": station_holdout_report(df, spec),
            "duplicate_daily_profile_check": duplicate_profiles(df).first().asDict(),
            "calibration_deciles_on_cell_holdout_test": {"ok": bool(deciles), "table": deciles},
        },
    }


def transfer_profiles(model: SleepModel, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict]:
    """Scores on tables without measured sleep: a daily profile each, and a summary."""
    profiles, summary = {}, {"feature_spec": model.features.as_dict()}
    for name, df in tables.items():
        scored = model.score(df)
        profiles[name] = kpis.score_profile(scored)
        found = kpis.dataset_summary(scored.drop("sleep_on"), "p_sleep_on").first().asDict()
        counts = {"rows": found["n_rows"], "bs": found["n_bs"], "cells": found["n_cells"]}
        summary[name] = counts | {"p_sleep_on_mean": found["p_mean"]}
    return profiles, summary
