"""Deterministic samples and group holdouts, chosen by the md5 of seed and key.

Picking n of N groups needs the n-th smallest hash, not a sorted list: rows are then
kept or held out by comparing their own hash with that cutoff, without any join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.functions.columns import cell_label
from wattcell.schema import CELL

_PREFIX = 3  # hex digits; at most 16**3 prefixes are counted


def key_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def group_key(keys: list[str]) -> Column:
    if len(keys) == 1:
        return F.col(keys[0])
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return cell_label(*texts) if keys == CELL else F.concat_ws("||", *texts)


def hash_cutoff(df: DataFrame, keys: list[str], seed: int, wanted: Callable[[int], int]) -> tuple[str, int, int]:
    """The n-th smallest hash among the distinct groups, with n and their number N.

    ``wanted`` gives n from N. Hashes spread evenly, so after counting by prefix only
    one prefix, about N/4096 groups, is looked at, and only its first few hashes are
    ordered. For n = 0 the cutoff is empty text, below every hash.
    """
    hashes = df.select(*keys).distinct().select(key_hash(seed, group_key(keys)).alias("h"))
    prefix = F.substring("h", 1, _PREFIX)
    counts = sorted((r["head"], r["n"]) for r in hashes.groupBy(prefix.alias("head")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    n = min(wanted(total), total)
    if n <= 0:
        return "", 0, total
    left = n
    for head, here in counts:
        if left <= here:
            break
        left -= here
    found = hashes.filter(prefix == head).orderBy("h").offset(left - 1).limit(1).first()
    return found["h"], n, total


def sample_cells(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of ``max(1, int(fraction * cells))`` cells."""
    if fraction >= 1:
        return df
    cutoff, _, _ = hash_cutoff(df, CELL, seed, lambda cells: max(1, int(cells * fraction)))
    return df.filter(key_hash(seed, group_key(CELL)) <= F.lit(cutoff))


def downsample(df: DataFrame, key: Column, max_rows: int = 5000, seed: int = 0) -> DataFrame:
    """At most ``max_rows`` rows for a chart, by the smallest hashes of a unique key."""
    return df.withColumn("_h", key_hash(seed, key)).orderBy("_h").limit(max_rows).drop("_h")
