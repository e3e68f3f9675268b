"""Running values over ordered series that stay parallel when one series is huge.

A window over (station, cell) puts a whole series into one task. That is right for
ordinary cells, which hold 48 rows a day, but a single cell may hold a third of the
table. Such hot cells are found by one pre-aggregated count and cut into blocks that
are contiguous in the series order: first by time slot, then by a range of the unique
arrival number. Each block is a window partition of its own; what flows from one block
into the next (a last value or a sum) is computed on the table of block totals by the
same rule, so every partition at every level is bounded:

* rows in a block:           2**SEQ_BITS distinct arrival numbers,
* blocks in a slot:          range of arrival numbers / 2**SEQ_BITS,
* slots in a series:         48 for every day covered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattcell.schema import CELL
from wattcell.session import materialize

HOT_CELL_ROWS = 5_000_000
SEQ_BITS = 20
HOT = "hot_cell"


@dataclass(frozen=True)
class Running:
    """One output column of :func:`running`.

    ``how`` is ``last`` (latest non-NULL value so far), ``sum`` (total so far) or
    ``prev`` (value of the preceding row, NULL included). ``inclusive`` says whether
    the current row counts for ``last`` and ``sum``.
    """

    name: str
    value: Column
    how: str = "last"
    inclusive: bool = True

    def local(self, window, boxed: bool) -> Column:
        if self.how == "prev":
            return F.lag(_box(self.value) if boxed else self.value).over(window)
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        if self.how == "sum":
            return F.sum(self.value).over(frame)
        return F.last(self.value, ignorenulls=True).over(frame)

    def total(self, place: str) -> Column:
        """Value that a whole block passes on to the next one."""
        if self.how == "sum":
            return F.sum(self.value)
        if self.how == "prev":
            return _box(F.max_by(self.value, place))
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(place)))

    def merge(self, carry: Column) -> Column:
        here = F.col(self.name)
        if self.how == "sum":
            return F.when(here.isNotNull() | carry.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        both = F.coalesce(here, carry)
        return both["v"] if self.how == "prev" else both


def _box(value: Column) -> Column:
    return F.struct(value.alias("v"))


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def deal(df: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """Store a table dealt to numbered ranges of ``order``; ``_range`` rises with it.

    The rows should differ in ``order``, so that a range never outgrows the others. The bounds
    are sampled by Spark; what is computed from the ranges must not depend on where they lie.
    """
    dealt = df.repartitionByRange(*([] if ranges is None else [ranges]), *order)
    return materialize(dealt.withColumn("_range", F.spark_partition_id()), name)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[Running],
    block: Sequence[str] = (),
    write_totals: bool = False,
) -> DataFrame:
    """Add running columns per ``keys`` in ``order``.

    ``block`` names columns that cut a series into stretches contiguous in ``order``,
    coarsest first, such that inside a stretch only the last column of ``order`` varies.
    Rows whose first block column is NULL belong to an uncut series.
    ``write_totals`` stores the block totals at once, so that chained calls do not
    repeat the plan of ``df`` for every level of blocks.
    """
    part, block = [*keys, *block], list(block)
    window = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumns({c.name: c.local(window, boxed=bool(block)) for c in columns})
    if not block:
        return out

    totals = (
        df.filter(F.col(block[0]).isNotNull())
        .groupBy(*part)
        .agg(*[c.total(order[-1]).alias(c.name) for c in columns])
    )
    if write_totals:
        totals = materialize(totals, "block_totals")
    into_block = [
        Running(f"_in_{c.name}", F.col(c.name), "sum" if c.how == "sum" else "last", inclusive=False) for c in columns
    ]
    carry = running(totals, keys, block, into_block, block[:-1])
    carry = carry.select(*[F.col(k).alias(f"_at_{k}") for k in part], *[c.name for c in into_block])
    # The block columns are never NULL on the carry side, so uncut rows match nothing.
    joined = out.join(carry, null_safe(out, carry, [(k, f"_at_{k}") for k in part]), "left")
    merged = {c.name: c.merge(F.col(f"_in_{c.name}")) for c in columns}
    return joined.withColumns(merged).drop(*carry.columns)


def mark_hot_cells(df: DataFrame, limit: int = HOT_CELL_ROWS) -> DataFrame:
    """Flag the rows of cells with more than ``limit`` rows.

    Costs one job over the two key columns. At most rows/limit keys can exceed the
    limit, which bounds both the list fetched here and its broadcast. Without such
    cells the frame comes back unchanged and all windows stay plain.
    """
    counted = df.groupBy(*CELL).count().filter(F.col("count") > limit).select(*CELL)
    found = counted.collect()
    if not found:
        return df
    hot = df.sparkSession.createDataFrame(found, counted.schema).toDF("_hot_bs", "_hot_cell").withColumn(HOT, F.lit(True))
    on = null_safe(df, hot, [("bs", "_hot_bs"), ("cell", "_hot_cell")])
    return df.join(F.broadcast(hot), on, "left").drop("_hot_bs", "_hot_cell")


def running_per_cell(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[Running],
    slot: Column,
) -> DataFrame:
    """:func:`running` for series inside a cell; hot cells are cut into blocks.

    With hot cells the rows are stored first: the block totals and the rows themselves read them, and the
    plan behind them would otherwise be run once more by every call of a chain.
    ``slot`` is a whole number that never falls along ``order``; inside a slot the
    order must be that of ``seq``.
    """
    if HOT not in df.columns:
        return running(df, keys, order, columns)
    cut = df.withColumns(
        {"_slot": F.when(F.col(HOT), slot), "_range": F.when(F.col(HOT), F.shiftright("seq", SEQ_BITS))}
    )
    cut = materialize(cut, "series")
    return running(cut, keys, order, columns, ["_slot", "_range"], write_totals=True).drop("_slot", "_range")
