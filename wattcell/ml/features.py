"""Feature columns and the label of the sleep-probability model."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.schema import require_columns


@dataclass(frozen=True)
class FeatureSpec:
    """Which groups of features a model uses; cyclical time only counts with time."""

    energy: bool = True
    prev: bool = True
    time: bool = True
    time_cyclical: bool = True

    def as_dict(self) -> dict:
        return asdict(self)


TRANSFER = FeatureSpec(energy=False)


def _optional(df: DataFrame, name: str) -> Column:
    return fx.number(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def feature_columns(df: DataFrame, spec: FeatureSpec = FeatureSpec()) -> dict[str, Column]:
    """Feature name to expression, in model order. No column of measured sleep is used.

    Users and the power of both units must exist even if the spec leaves power out;
    derived columns that are missing become NULL, except traffic in MB, which is left out.
    """
    require_columns(df, ["prb", "traffic_kb", "users", "bbu_w", "rru_w"], "feature_columns")
    out = {c: fx.number(F.col(c)) for c in ("prb", "traffic_kb", "users")}
    if spec.energy:
        out |= {c: fx.number(F.col(c)) for c in ("bbu_w", "rru_w")}
    if spec.time:
        out["tod_bin"] = _optional(df, "tod_bin")
        if spec.time_cyclical:
            if "tod_bin" in df.columns:
                angle = fx.day_angle(F.col("tod_bin"))
                out |= {"tod_sin": F.sin(angle), "tod_cos": F.cos(angle)}
            else:
                out |= {c: F.lit(None).cast("double") for c in ("tod_sin", "tod_cos")}
    if "traffic_mb" in df.columns:
        out["traffic_mb"] = fx.number(F.col("traffic_mb"))
    if spec.prev:
        out |= {c: _optional(df, c) for c in ("prev_traffic_mb", "prev_users")}
    return out


def feature_matrix(df: DataFrame, spec: FeatureSpec = FeatureSpec(), keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature columns alone, after the columns to ``keep``."""
    return df.select(*[F.col(k).alias(k) for k in keep], *[e.alias(c) for c, e in feature_columns(df, spec).items()])


def label(df: DataFrame) -> Column:
    require_columns(df, ["sleep_on"], "label")
    return F.coalesce(F.col("sleep_on"), F.lit(False)).cast("int")
