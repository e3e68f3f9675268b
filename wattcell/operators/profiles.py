"""Cells with identical daily load profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.functions.columns import ratio_or_zero
from wattcell.operators.ordered import Running, running_per_cell
from wattcell.schema import CELL, require_columns


def profile_signatures(df: DataFrame) -> DataFrame:
    """One row per cell: digest of its ordered loads, rounded half-even to two decimals.

    The loads of a cell are numbered in order. Every pair of number and load is hashed to 128
    bits, and the hashes of a cell are combined bit by bit, which needs no order and no list
    and is done before the shuffle as well. The count is part of the digest.
    """
    require_columns(df, [*CELL, "tod_bin", "prb", "seq"], "profile_signatures")
    rows = df.filter(F.col("prb").isNotNull())
    numbered = running_per_cell(rows, CELL, ["tod_bin", "seq"], [Running("_at", F.lit(1), "sum")], F.col("tod_bin"))
    # Adding 0.0 turns a rounded -0.0 into 0.0, as equal numbers must give equal hashes.
    load = F.bround("prb", 2) + F.lit(0.0)
    halves = [F.hex(F.bit_xor(F.xxhash64(F.lit(i), "_at", load))) for i in (1, 2)]
    digest = F.concat_ws("-", F.count(F.lit(1)).cast("string"), *halves)
    return numbered.groupBy(*CELL).agg(digest.alias("signature"))


def duplicate_profiles(df: DataFrame) -> DataFrame:
    """One row: cells, distinct profiles, largest group and share of cells in groups."""
    groups = profile_signatures(df).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_cells"),
        F.count(F.lit(1)).alias("n_unique_profiles"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_duplicate_count"),
        F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("_shared"),
    )
    cells = F.col("n_cells").cast("double")
    return out.select(
        (F.col("n_cells") > 0).alias("ok"),
        "n_cells",
        "n_unique_profiles",
        ratio_or_zero(F.col("n_unique_profiles"), cells).alias("frac_unique_profiles"),
        "max_duplicate_count",
        ratio_or_zero(F.col("_shared"), cells).alias("frac_cells_in_duplicate_groups"),
    )
