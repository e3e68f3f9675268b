"""Train/test splits that keep cells or stations apart. Both add ``is_test`` to every row."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.operators.ordered import null_safe
from wattcell.operators.sampling import group_key, hash_cutoff, key_hash
from wattcell.schema import CELL, require_columns
from wattcell.session import materialize

LAST_DAYS, CELL_GROUPS, STATION_GROUPS = "last_days_per_cell", "cell_group_holdout", "base_station_holdout"


@dataclass(frozen=True)
class SplitSpec:
    test_days: int = 1
    test_fraction: float = 0.2
    seed: int = 0


class DegenerateSplit(ValueError):
    """One side of the split has no rows."""


def last_days_holdout(df: DataFrame, spec: SplitSpec = SplitSpec(), check: bool = True) -> DataFrame:
    """Test rows are the last ``test_days`` days of each cell.

    The last day per cell is an aggregate joined back, not a window, so a huge cell does
    not end up in one task. It is stored once for the check and the join, which is a
    broadcast if that size allows.
    """
    require_columns(df, [*CELL, "day_index"], "last_days_holdout")
    last = df.groupBy(*CELL).agg(F.max("day_index").alias("_last"), F.min("day_index").alias("_first"))
    last = materialize(last, "last_days")
    if check:
        # A cell gives training rows exactly if its first day lies before its last ones.
        span = last.agg(
            F.count(F.lit(1)).alias("cells"),
            F.count_if(F.col("_first") < F.col("_last") - (spec.test_days - 1)).alias("both"),
            F.count_if(F.col("_last").isNull()).alias("unknown"),
        ).first()
        if span["unknown"]:
            raise ValueError("last_days_holdout: day_index has missing values")
        if not span["cells"] or not span["both"] or spec.test_days < 1:
            raise DegenerateSplit("last_days_holdout: one side is empty, probably one day per cell")
    side = last.select(F.col("bs").alias("_l_bs"), F.col("cell").alias("_l_cell"), "_last")
    joined = df.join(side, null_safe(df, side, [("bs", "_l_bs"), ("cell", "_l_cell")]), "left")
    flag = F.col("day_index") >= F.col("_last") - F.lit(spec.test_days - 1)
    return joined.withColumn("is_test", flag).drop("_l_bs", "_l_cell", "_last")


def group_holdout(df: DataFrame, keys: list[str] = CELL, spec: SplitSpec = SplitSpec()) -> DataFrame:
    """Test rows belong to ``ceil(fraction * groups)`` groups, chosen by the hash of their key."""
    cutoff, held, groups = hash_cutoff(df, keys, spec.seed, lambda n: math.ceil(spec.test_fraction * n))
    if held == 0 or held == groups:
        raise DegenerateSplit(f"group_holdout: {held} of {groups} groups held out")
    return df.withColumn("is_test", key_hash(spec.seed, group_key(keys)) <= F.lit(cutoff))


def adaptive_split(df: DataFrame, spec: SplitSpec = SplitSpec()) -> tuple[DataFrame, str]:
    """Last days if every side has rows, else a holdout of cells; with the strategy used."""
    try:
        return last_days_holdout(df, spec), LAST_DAYS
    except DegenerateSplit:
        return group_holdout(df, CELL, spec), CELL_GROUPS


def describe_split(df: DataFrame) -> DataFrame:
    """Rows, stations, cell ids and day range of each side (one row per side)."""
    dated = "day_index" in df.columns
    ends = [F.min("day_index").alias("_min"), F.max("day_index").alias("_max")] if dated else []
    per_cell = df.groupBy("is_test", *CELL).agg(F.count(F.lit(1)).alias("_n"), *ends)
    days = [F.min("_min").alias("day_min"), F.max("_max").alias("day_max")] if dated else []
    return per_cell.groupBy("is_test").agg(
        F.sum("_n").alias("n_rows"),
        F.countDistinct("bs").alias("n_bs"),
        F.countDistinct("cell").alias("n_cells"),
        *days,
    )


def split_report(df: DataFrame, strategy: str) -> dict:
    sides = {row["is_test"]: row.asDict() for row in describe_split(df).collect()}
    empty = {"n_rows": 0, "n_bs": 0, "n_cells": 0}
    train, test = sides.get(False, empty), sides.get(True, empty)
    out = {"strategy": strategy, "n_rows": train["n_rows"] + test["n_rows"]}
    for name, side in (("train", train), ("test", test)):
        out |= {f"{name}_rows": side["n_rows"], f"{name}_bs": side["n_bs"], f"{name}_cells": side["n_cells"]}
        if "day_min" in side:
            out[f"{name}_day_minmax"] = [side["day_min"], side["day_max"]]
    return out
