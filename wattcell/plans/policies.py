"""One entry point for both controllers, and the views reports are made from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from wattcell.operators import kpis
from wattcell.operators.policy import ProbabilityController, load_policy, probability_policy

HEURISTIC, LEARNED = "Heuristic", "ML"
ALL_DAY, TIME_BIN = "All day", "Time bin"


@dataclass(frozen=True)
class PolicySpec:
    """Everything that decides the states of a policy table."""

    controller: str = HEURISTIC
    scope: str = "Global"
    alpha: float = 0.45
    hysteresis: bool = True
    h_sleep: float = 2.0
    h_eco: float = 2.0
    probability: ProbabilityController = field(default_factory=ProbabilityController)
    decimals: int | None = None


def policy_table(
    prepared: DataFrame, spec: PolicySpec = PolicySpec(), thresholds: DataFrame | None = None, model=None
) -> DataFrame:
    """Prepared table with thresholds, states and energy.

    The learned controller scores with ``model`` unless ``p_sleep_on`` is already there.
    """
    if spec.controller == HEURISTIC:
        return load_policy(
            prepared, spec.scope, spec.alpha, spec.hysteresis, spec.h_sleep, spec.h_eco,
            thresholds=thresholds, decimals=spec.decimals,
        )
    if spec.controller == LEARNED:
        if model is not None:
            prepared = model.score(prepared)
        elif "p_sleep_on" not in prepared.columns:
            raise ValueError("policy_table: the learned controller needs a model or a p_sleep_on column")
        return probability_policy(prepared, spec.probability, spec.alpha)
    raise ValueError(f"unknown controller {spec.controller!r}; use {HEURISTIC!r} or {LEARNED!r}")


def view(policy: DataFrame, tod_bin: int | None = None) -> DataFrame:
    """The whole policy table, or one time-of-day bin of it (states are kept)."""
    return policy if tod_bin is None else kpis.slice_time_of_day(policy, tod_bin)


def bs_summary_of(prepared: DataFrame, spec: PolicySpec, tod_bin: int | None = None, **given) -> DataFrame:
    return kpis.bs_summary(view(policy_table(prepared, spec, **given), tod_bin))


def cell_kpis_of(prepared: DataFrame, spec: PolicySpec, tod_bin: int | None = None, **given) -> DataFrame:
    return kpis.cell_kpis(view(policy_table(prepared, spec, **given), tod_bin))
