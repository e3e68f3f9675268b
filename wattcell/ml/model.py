"""Training, calibration, scoring and storage of the sleep-probability model."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.ml.features import FeatureSpec, feature_columns, label
from wattcell.ml.isotonic import fit_isotonic
from wattcell.ml.split import SplitSpec
from wattcell.operators.quantiles import medians
from wattcell.operators.sampling import group_key
from wattcell.schema import CELL
from wattcell.session import side_by_side, use_checkpoint_dir
from wattcell.sources.sinks import read_report, write_report

LOGISTIC, BOOSTED = "logreg", "hgb"
ISOTONIC, SIGMOID = "isotonic", "sigmoid"


@dataclass(frozen=True)
class TrainSpec:
    """Defaults follow the usual setup: 300 boosting rounds of depth 6 at rate 0.05."""

    model_type: str = BOOSTED
    calibrate: bool = True
    method: str = ISOTONIC
    folds: int = 3
    seed: int = 0
    rounds: int = 300
    depth: int = 6
    rate: float = 0.05
    logistic_iterations: int = 500
    split: SplitSpec = field(default_factory=SplitSpec)
    features: FeatureSpec = field(default_factory=FeatureSpec)


@dataclass(frozen=True)
class Member:
    """One fitted classifier and the calibrator of its margin, if any."""

    classifier: PipelineModel
    calibrator: IsotonicRegressionModel | LogisticRegressionModel | None = None


@dataclass(frozen=True)
class SleepModel:
    """Averaged members over median-filled features; knows the features it was trained on."""

    features: FeatureSpec
    names: list[str]
    fill: dict[str, float]
    members: list[Member]
    method: str | None = None

    def score(self, df: DataFrame, out: str = "p_sleep_on") -> DataFrame:
        """Add the probability of deep sleep, within [0, 1]."""
        inputs = list(df.columns)
        scored = _assembled(df, feature_columns(df, self.features), self.fill, self.names)
        probabilities = []
        for i, member in enumerate(self.members):
            scored, p = _member_score(scored, member, i)
            probabilities.append(p)
        mean = reduce(lambda a, b: a + b, probabilities) / F.lit(float(len(probabilities)))
        return scored.withColumn("_p", fx.clip(mean)).select(*[c for c in inputs if c != out], F.col("_p").alias(out))


def _assembled(df: DataFrame, columns: dict[str, Column], fill: dict[str, float], names: list[str]) -> DataFrame:
    """Vector column of the features, missing values replaced by their training median."""
    filled = F.struct(*[F.coalesce(columns[c], F.lit(float(fill[c]))).alias(c) for c in names])
    wide = df.withColumn("_f", filled)
    wide = wide.withColumns({f"_f_{c}": F.col(f"_f.{c}") for c in names})
    assembler = VectorAssembler(inputCols=[f"_f_{c}" for c in names], outputCol="_x")
    return assembler.transform(wide).drop("_f", *[f"_f_{c}" for c in names])


def _member_score(df: DataFrame, member: Member, i: int) -> tuple[DataFrame, Column]:
    drop = ["rawPrediction", "probability", "prediction", "_scaled"]
    df = member.classifier.transform(df)
    df = df.withColumns(
        {
            f"_margin_{i}": vector_to_array("rawPrediction")[1],
            f"_plain_{i}": vector_to_array("probability")[1],
        }
    ).drop(*drop)
    if member.calibrator is None:
        return df, F.col(f"_plain_{i}")
    return _calibrated(df, member.calibrator, f"_margin_{i}", f"_cal_{i}"), F.col(f"_cal_{i}")


def _calibrated(df: DataFrame, calibrator, margin: str, out: str) -> DataFrame:
    if isinstance(calibrator, IsotonicRegressionModel):
        return calibrator.copy({calibrator.featuresCol: margin, calibrator.predictionCol: out}).transform(df)
    slope, shift = float(calibrator.coefficients[0]), float(calibrator.intercept)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(margin) * slope + shift))))


def _base(spec: TrainSpec) -> Pipeline:
    if spec.model_type == LOGISTIC:
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="_x", outputCol="_scaled")
        fit = LogisticRegression(featuresCol="_scaled", labelCol="_y", maxIter=spec.logistic_iterations)
        return Pipeline(stages=[scaler, fit])
    if spec.model_type == BOOSTED:
        fit = GBTClassifier(
            featuresCol="_x", labelCol="_y", maxIter=spec.rounds, maxDepth=spec.depth, stepSize=spec.rate, seed=spec.seed
        )
        return Pipeline(stages=[fit])
    raise ValueError(f"unknown model type {spec.model_type!r}; use {LOGISTIC!r} or {BOOSTED!r}")


def _fit_calibrator(df: DataFrame, method: str):
    if method == ISOTONIC:
        return fit_isotonic(df, "_margin_0", "_y")
    if method == SIGMOID:
        vector = VectorAssembler(inputCols=["_margin_0"], outputCol="_m")
        return LogisticRegression(featuresCol="_m", labelCol="_y").fit(vector.transform(df))
    raise ValueError(f"unknown calibration {method!r}; use {ISOTONIC!r} or {SIGMOID!r}")


def fold_of(df_keys: Column, folds: int, seed: int) -> Column:
    """Fold of a cell; whole cells stay together."""
    return F.pmod(F.xxhash64(F.lit(int(seed)), df_keys), F.lit(int(folds)))


def fit_sleep_model(train: DataFrame, spec: TrainSpec = TrainSpec()) -> SleepModel:
    """Fit on all rows of ``train``, which must hold both classes.

    With calibration each fold of cells calibrates a classifier fitted on the others. A fold that
    holds one class only, or leaves one class only to the others, is an error.
    The assembled rows are cached while the fits run: boosting reads them every round. The folds are
    fitted side by side, as the jobs of a round are too short to keep a cluster busy.
    """
    use_checkpoint_dir(train.sparkSession)
    columns = feature_columns(train, spec.features)
    names = list(columns)
    found = medians(train.select(*[e.alias(c) for c, e in columns.items()]), names)
    fill = {c: (0.0 if v is None else v) for c, v in found.items()}
    rows = _assembled(train, columns, fill, names).select(
        "_x", label(train).cast("double").alias("_y"), fold_of(group_key(CELL), spec.folds, spec.seed).alias("_fold")
    )
    rows = rows.persist()
    try:
        members = []
        if not spec.calibrate:
            members.append(Member(_base(spec).fit(rows)))
        else:
            seen = {
                (r["_fold"], r["_y"]) for r in rows.select("_fold", "_y").distinct().collect()
            }
            for k in range(spec.folds):
                here = {y for f, y in seen if f == k}
                others = {y for f, y in seen if f != k}
                if len(here) < 2 or len(others) < 2:
                    raise ValueError(f"fit_sleep_model: fold {k} of {spec.folds}, or the others, lack a class; use fewer folds")

            def member(k: int) -> Member:
                part = _base(spec).fit(rows.filter(F.col("_fold") != k))
                held, _ = _member_score(rows.filter(F.col("_fold") == k), Member(part), 0)
                return Member(part, _fit_calibrator(held, spec.method))

            members = side_by_side(train.sparkSession, member, range(spec.folds))
    finally:
        rows.unpersist()
    return SleepModel(spec.features, names, fill, members, spec.method if spec.calibrate else None)


# -- storage -------------------------------------------------------------------------


def save_bundle(spark: SparkSession, model: SleepModel, report: dict, out_dir: str, name: str = "sleep_on_model") -> dict:
    """Model folder and report; the feature choice is stored with the model."""
    root = posixpath.join(out_dir, name)
    for i, member in enumerate(model.members):
        member.classifier.write().overwrite().save(f"{root}/member={i}/classifier")
        if member.calibrator is not None:
            member.calibrator.write().overwrite().save(f"{root}/member={i}/calibrator")
    about = {
        "features": model.features.as_dict(),
        "names": model.names,
        "fill": model.fill,
        "method": model.method,
        "members": len(model.members),
    }
    write_report(spark, about, f"{root}/about")
    write_report(spark, report, f"{root}.report")
    return {"model_path": root, "report_path": f"{root}.report"}


def load_bundle(spark: SparkSession, path: str, expect: FeatureSpec | None = None) -> SleepModel:
    """Load a stored model; ``expect`` must equal the features it was trained on."""
    try:
        about = read_report(spark, f"{path}/about")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    spec = FeatureSpec(**about["features"])
    if expect is not None and expect != spec:
        raise ValueError(f"model was trained on {spec}, not on {expect}")
    kinds = {ISOTONIC: IsotonicRegressionModel, SIGMOID: LogisticRegressionModel}
    members = []
    for i in range(about["members"]):
        calibrator = None
        if about["method"] is not None:
            calibrator = kinds[about["method"]].load(f"{path}/member={i}/calibrator")
        members.append(Member(PipelineModel.load(f"{path}/member={i}/classifier"), calibrator))
    return SleepModel(spec, about["names"], about["fill"], members, about["method"])
