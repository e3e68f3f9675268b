"""Power states per interval and the energy they save.

Both controllers are state machines over the intervals of a cell and day. They are
written as running values: each row is an event that either forces a state, changes
only some states, or changes nothing, so the state after a row follows from the last
deciding event and from a parity count since then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators.ordered import Running, running_per_cell
from wattcell.operators.prepare import DAY_KEYS
from wattcell.operators.thresholds import MIN_SAMPLES, with_thresholds
from wattcell.schema import ensure_threshold_columns, require_columns

DAY_ORDER = ["tod_bin", "seq"]


@dataclass(frozen=True)
class ProbabilityController:
    """Thresholds on the sleep probability: enter ECO at ``tau_on``, leave at ``tau_off``."""

    tau_on: float = 0.80
    tau_off: float = 0.70
    hysteresis: bool = True

    @property
    def exit_level(self) -> float:
        return float(min(self.tau_on, self.tau_off)) if self.hysteresis else float(self.tau_on)


def _load_event(h_sleep: float, h_eco: float) -> Column:
    """What one interval does to the state, from ``prb``, ``p30`` and ``p70``.

    ========  ====================================================
    S, E, F   any state becomes SLEEP, ECO, FULL
    A         FULL becomes ECO; ECO and SLEEP stay
    B         SLEEP becomes FULL; FULL and ECO stay
    T         FULL and ECO change places; SLEEP stays
    NULL      nothing is known, the state stays
    ========  ====================================================

    T needs a band where the level that leaves ECO lies below the one that leaves SLEEP,
    which happens only if ``h_sleep`` is larger than ``h_eco``.
    """
    enter_sleep, leave_sleep = f"p30 - {h_sleep!r}D", f"p30 + {h_sleep!r}D"
    enter_eco, leave_eco = f"greatest(p70 - {h_eco!r}D, {leave_sleep})", f"p70 + {h_eco!r}D"
    return F.expr(f"""
        CASE WHEN prb IS NULL OR p30 IS NULL OR p70 IS NULL THEN NULL
             WHEN prb < {enter_sleep} THEN 'S'
             WHEN prb < {leave_sleep} THEN IF(prb >= {leave_eco}, 'T', 'A')
             WHEN prb < {enter_eco} THEN 'E'
             WHEN prb < {leave_eco} THEN 'B'
             ELSE 'F' END""")


def hysteresis_states(df: DataFrame, h_sleep: float = 2.0, h_eco: float = 2.0) -> DataFrame:
    """Add ``state`` by the three-state rule with hysteresis, starting each day in FULL.

    UNKNOWN rows do not change the state that is carried on.
    """
    if h_sleep < 0 or h_eco < 0:
        raise ValueError("hysteresis margins must not be negative")
    require_columns(df, [*DAY_KEYS, "tod_bin", "seq", "prb", "p30", "p70"], "hysteresis_states")
    slot = F.col("tod_bin")
    df = df.withColumn("_ev", _load_event(float(h_sleep), float(h_eco)))
    ev, place = F.col("_ev"), F.struct(*DAY_ORDER)

    first = [
        Running("_hard", F.when(ev.isin("S", "E", "F"), F.struct(place.alias("at"), ev.alias("ev")))),
        Running("_last_b", F.when(ev == "B", place), inclusive=False),
        Running("_flips", F.when(ev == "T", 1).otherwise(0), "sum"),
    ]
    df = running_per_cell(df, DAY_KEYS, DAY_ORDER, first, slot)

    # While a forced SLEEP holds, the first B wakes the cell; A and T count only after it.
    asleep = F.coalesce(F.col("_hard.ev") == "S", F.lit(False))
    woken = F.coalesce(F.col("_last_b") > F.col("_hard.at"), F.lit(False))
    decides = (
        F.when(ev.isin("S", "E", "F"), ev)
        .when((ev == "A") & (~asleep | woken), "E")
        .when((ev == "B") & asleep & ~woken, "F")
    )
    anchor = F.when(decides.isNotNull(), F.struct(decides.alias("ev"), F.col("_flips").alias("flips")))
    df = running_per_cell(df, DAY_KEYS, DAY_ORDER, [Running("_anchor", anchor)], slot)

    base = F.coalesce(F.col("_anchor.ev"), F.lit("F"))
    odd = (F.col("_flips") - F.coalesce(F.col("_anchor.flips"), F.lit(0))) % 2 == 1
    state = (
        F.when(ev.isNull(), "UNKNOWN")
        .when(base == "S", "SLEEP")
        .when((base == "E") != odd, "ECO")
        .otherwise("FULL")
    )
    return df.withColumn("state", state).drop("_ev", "_hard", "_last_b", "_flips", "_anchor")


def with_energy(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumns(
        {
            "baseline_wh": fx.baseline_wh(F.col("rru_w")),
            "eco_saved_wh": fx.eco_saved_wh(F.col("rru_w"), F.col("state"), alpha),
        }
    )


def load_policy(
    df: DataFrame,
    scope: str = "Global",
    alpha: float = 0.45,
    hysteresis: bool = True,
    h_sleep: float = 2.0,
    h_eco: float = 2.0,
    thresholds: DataFrame | None = None,
    min_n: int = MIN_SAMPLES,
    decimals: int | None = None,
) -> DataFrame:
    """Heuristic controller on load percentiles, and its simulated energy."""
    df = with_thresholds(df, scope, thresholds, min_n, decimals)
    if hysteresis:
        df = hysteresis_states(df, h_sleep, h_eco)
    else:
        df = df.withColumn("state", fx.plain_state(F.col("prb"), F.col("p30"), F.col("p70")))
    return with_energy(df, alpha)


def probability_states(
    df: DataFrame, controllers: dict[str, ProbabilityController], p: str = "p_sleep_on"
) -> DataFrame:
    """Add one state column per controller, all from the same ordered pass.

    A missing probability keeps the state. Rows at a level that both enters and leaves
    ECO (only possible when the two levels coincide) swap the state.
    """
    require_columns(df, [*DAY_KEYS, "tod_bin", "seq", p], "probability_states")
    slot = F.col("tod_bin")
    forced, flips = {}, {}
    for name, c in controllers.items():
        on, off = f"{float(c.tau_on)!r}D", f"{c.exit_level!r}D"
        if c.exit_level < c.tau_on:
            forced[name] = F.expr(f"CASE WHEN `{p}` >= {on} THEN 'ECO' WHEN `{p}` <= {off} THEN 'FULL' END")
        else:
            forced[name] = F.expr(f"CASE WHEN `{p}` > {on} THEN 'ECO' WHEN `{p}` < {off} THEN 'FULL' END")
            flips[name] = F.expr(f"IF(`{p}` = {on}, 1, 0)")

    first = [Running(f"_n_{name}", flip, "sum") for name, flip in flips.items()]
    if first:
        df = running_per_cell(df, DAY_KEYS, DAY_ORDER, first, slot)
    anchors = []
    for name, event in forced.items():
        if name in flips:
            event = F.when(event.isNotNull(), F.struct(event.alias("ev"), F.col(f"_n_{name}").alias("n")))
        anchors.append(Running(f"_a_{name}", event))
    df = running_per_cell(df, DAY_KEYS, DAY_ORDER, anchors, slot)

    states = {}
    for name in controllers:
        if name in flips:
            base = F.coalesce(F.col(f"_a_{name}.ev"), F.lit("FULL")) == "ECO"
            odd = (F.col(f"_n_{name}") - F.coalesce(F.col(f"_a_{name}.n"), F.lit(0))) % 2 == 1
            states[name] = F.when(base != odd, "ECO").otherwise("FULL")
        else:
            states[name] = F.coalesce(F.col(f"_a_{name}"), F.lit("FULL"))
    scratch = [f"_n_{name}" for name in flips] + [f"_a_{name}" for name in forced]
    return df.withColumns(states).drop(*scratch)


def probability_policy(
    df: DataFrame, controller: ProbabilityController = ProbabilityController(), alpha: float = 0.45
) -> DataFrame:
    """Controller on ``p_sleep_on`` (already scored) and its simulated energy."""
    df = probability_states(df.drop("state"), {"state": controller})
    return ensure_threshold_columns(with_energy(df, alpha))
