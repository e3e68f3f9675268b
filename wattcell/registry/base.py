"""Shared pieces of the registered queries: Spark inputs, and SQL for the same inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattcell.operators.policy import load_policy
from wattcell.operators.prepare import prepare
from wattcell.sources.adapters import events_telemetry

ALPHA = 0.45
DECIMALS = 6
# Means of 64 rows and sums in kWh often end in an exact 5 behind the last kept digit, where
# the order of summation decides the rounding. Both engines add this before they round.
OFF_TIES = 1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query, with the SQL that must give the same rows."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: tidy(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded after aggregation, counts as bigint: comparable across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + F.lit(OFF_TIES), DECIMALS) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# -- Spark inputs ------------------------------------------------------------------------


def prepared(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return prepare(events_telemetry(spark, sf_dir), **options)


def policy(spark: SparkSession, sf_dir: str, scope: str = "Global", hysteresis: bool = False, **options) -> DataFrame:
    day_mode = options.pop("day_mode", None)
    rows = prepared(spark, sf_dir, day_mode=day_mode)
    return load_policy(rows, scope, ALPHA, hysteresis, decimals=DECIMALS, **options)


def scored(spark: SparkSession, sf_dir: str, tenths: bool = False) -> DataFrame:
    """A sleep score that needs no model: the lower the load, the higher.

    In ``tenths`` only eleven scores exist, so many rows lie exactly on a level.
    """
    score = F.round(1.0 - F.col("prb") / 100.0, DECIMALS)
    return prepared(spark, sf_dir).withColumn("p_sleep_on", F.floor(score * 10) / 10 if tenths else score)


# -- the same inputs in SQL --------------------------------------------------------------


def r(expression: str, name: str | None = None) -> str:
    name = name or expression
    return f"round({expression} + {OFF_TIES}, {DECIMALS}) + 0.0 AS {name}"


def n(expression: str, name: str) -> str:
    return f"cast({expression} AS bigint) AS {name}"


def sql(*parts: str) -> str:
    """Common table expressions followed by the final SELECT."""
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()


TEL = """
tel AS (
  SELECT concat('B_', cast(user_id % 25 AS varchar)) AS bs,
         concat('C_', cast(user_id % 6 AS varchar)) AS cell,
         event_id AS seq, ts, cast(ts AS date) AS d,
         cast(hour(ts) AS bigint) AS hour, cast(minute(ts) AS bigint) AS minute,
         cast(hour(ts) * 2 + CASE WHEN minute(ts) >= 30 THEN 1 ELSE 0 END AS bigint) AS tod_bin,
         value % 100 AS prb, value * 1000 AS traffic_kb,
         cast(regexp_extract(props, '[0-9]+', 0) AS double) AS users,
         cast(80 + user_id % 20 AS double) AS bbu_w,
         cast(100 AS double) + (value % 100) * 2 AS rru_w,
         CASE WHEN value % 100 < 25 AND event_id % 5 <> 0
              THEN cast((event_id * 37) % 2000 * 1000 AS double) ELSE cast(0 AS double) END AS ds_ms
  FROM events)
"""

_LABELLED = """
labelled AS (
  SELECT *, format('{:02d}:{:02d}', tod_bin // 2, tod_bin % 2 * 30) AS time_of_day,
         traffic_kb / 1024 AS traffic_mb, ds_ms / 1000 AS deep_sleep_s,
         coalesce(ds_ms > 0, false) AS sleep_on,
         least(greatest(ds_ms / 1000, 0) / 1800, 1) AS sleep_frac
  FROM tel)
"""


def prep(day_mode: str = "date") -> str:
    """Derived columns, in ``prep``."""
    order = {"date": "d, hour * 60 + minute, seq", "reference": "hour * 60 + minute, seq", "sequence": "seq"}[day_mode]
    day = {
        "date": "dense_rank() OVER (PARTITION BY bs, cell ORDER BY d) - 1",
        "reference": "0",
        "sequence": "sum(CASE WHEN tod_bin < before THEN 1 ELSE 0 END) OVER (PARTITION BY bs, cell ORDER BY seq)",
    }[day_mode]
    return f"""{TEL.strip()},
{_LABELLED.strip()},
lagged AS (
  SELECT *, lag(traffic_mb) OVER w AS prev_traffic_mb, lag(users) OVER w AS prev_users, lag(tod_bin) OVER w AS before
  FROM labelled WINDOW w AS (PARTITION BY bs, cell ORDER BY {order})),
prep AS (SELECT *, cast({day} AS bigint) AS day_index FROM lagged)"""


PREP = prep()

KEYS = {"Global": "tod_bin", "Per-BaseStation": "bs, tod_bin", "Per-Cell": "bs, cell, tod_bin"}
_PAIR = """CASE WHEN count(prb) >= 10 THEN round(quantile_cont(prb, 0.3), 6) END AS p30,
         CASE WHEN count(prb) >= 10 THEN round(quantile_cont(prb, 0.7), 6) END AS p70"""


def thr(scope: str) -> str:
    """Threshold table of a scope in ``thr0``; with the global fallback in ``thr``."""
    keys = KEYS[scope]
    return f"""thr0 AS (SELECT {keys}, {_PAIR} FROM prep GROUP BY {keys}),
whole AS (SELECT {_PAIR} FROM prep),
fb AS (SELECT count(p30) = 0 OR count(p70) = 0 AS needed FROM thr0),
thr AS (
  SELECT {keys},
         CASE WHEN (SELECT needed FROM fb) THEN (SELECT p30 FROM whole) ELSE p30 END AS p30,
         CASE WHEN (SELECT needed FROM fb) THEN (SELECT p70 FROM whole) ELSE p70 END AS p70
  FROM thr0)"""


def _joined(scope: str) -> str:
    on = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM t.{k.strip()}" for k in KEYS[scope].split(","))
    return f"joined AS (SELECT a.*, t.p30, t.p70 FROM prep a LEFT JOIN thr t ON {on})"


_ENERGY = """
pol AS (
  SELECT *, coalesce(rru_w, 0) * 0.5 AS baseline_wh,
         CASE WHEN state = 'ECO' THEN 0.45 * coalesce(rru_w, 0) * 0.5 ELSE 0.0 END AS eco_saved_wh
  FROM stated)
"""

_UNKNOWN = "prb IS NULL OR p30 IS NULL OR p70 IS NULL"


def pol_plain(scope: str = "Global", day_mode: str = "date") -> str:
    return f"""{prep(day_mode)},
{thr(scope)},
{_joined(scope)},
stated AS (
  SELECT *, CASE WHEN {_UNKNOWN} THEN 'UNKNOWN' WHEN prb < p30 THEN 'SLEEP' WHEN prb < p70 THEN 'ECO'
                 ELSE 'FULL' END AS state
  FROM joined),
{_ENERGY.strip()}"""


def pol_hysteresis(scope: str = "Global", h_sleep: float = 2.0, h_eco: float = 2.0, day_mode: str = "date") -> str:
    """The state machine as a recursion from row to row of each cell and day."""
    eco = f"greatest(p70 - {h_eco}, p30 + {h_sleep})"
    rule = f"""CASE WHEN {_UNKNOWN} THEN 'UNKNOWN'
      WHEN was = 'FULL' THEN CASE WHEN prb < p30 - {h_sleep} THEN 'SLEEP' WHEN prb < {eco} THEN 'ECO' ELSE 'FULL' END
      WHEN was = 'ECO' THEN CASE WHEN prb < p30 - {h_sleep} THEN 'SLEEP' WHEN prb >= p70 + {h_eco} THEN 'FULL' ELSE 'ECO' END
      WHEN prb >= p30 + {h_sleep} THEN CASE WHEN prb < {eco} THEN 'ECO' ELSE 'FULL' END
      ELSE 'SLEEP' END"""
    return f"""{prep(day_mode)},
{thr(scope)},
{_joined(scope)},
line AS (
  SELECT bs, cell, day_index, seq, prb, p30, p70,
         row_number() OVER (PARTITION BY bs, cell, day_index ORDER BY tod_bin, seq) AS rn
  FROM joined),
walk AS (
  SELECT bs, cell, day_index, seq, rn, state, CASE WHEN state = 'UNKNOWN' THEN was ELSE state END AS carry
  FROM (SELECT *, {rule} AS state FROM (SELECT *, 'FULL' AS was FROM line WHERE rn = 1))
  UNION ALL
  SELECT bs, cell, day_index, seq, rn, state, CASE WHEN state = 'UNKNOWN' THEN was ELSE state END AS carry
  FROM (SELECT *, {rule} AS state
        FROM (SELECT l.*, w.carry AS was FROM walk w JOIN line l
              ON l.bs = w.bs AND l.cell = w.cell AND l.day_index = w.day_index AND l.rn = w.rn + 1))),
stated AS (SELECT j.*, w.state FROM joined j JOIN walk w ON j.seq = w.seq),
{_ENERGY.strip()}"""


def score_sql(tenths: bool = False) -> str:
    score = f"round(1.0 - prb / 100.0, {DECIMALS})"
    score = f"floor({score} * 10) / 10" if tenths else score
    return f"{PREP},\nsc AS (SELECT *, {score} AS p_sleep_on FROM prep)"


def pol_probability(levels: list[tuple[float, float]], source: str = "sc") -> str:
    """The two-state machine for each (on, off) pair of levels, row by row."""
    values = ", ".join(f"({on!r}e0, {off!r}e0)" for on, off in levels)
    rule = """CASE WHEN p_sleep_on IS NULL THEN was
      WHEN was = 'FULL' THEN CASE WHEN p_sleep_on >= tau_on THEN 'ECO' ELSE 'FULL' END
      WHEN p_sleep_on <= tau_off THEN 'FULL' ELSE 'ECO' END"""
    return f"""levels AS (SELECT * FROM (VALUES {values}) v(tau_on, tau_off)),
line AS (
  SELECT tau_on, tau_off, bs, cell, day_index, seq, p_sleep_on,
         row_number() OVER (PARTITION BY tau_on, bs, cell, day_index ORDER BY tod_bin, seq) AS rn
  FROM {source}, levels),
walk AS (
  SELECT tau_on, bs, cell, day_index, seq, rn, {rule} AS state FROM (SELECT *, 'FULL' AS was FROM line WHERE rn = 1)
  UNION ALL
  SELECT tau_on, bs, cell, day_index, seq, rn, {rule} AS state
  FROM (SELECT l.*, w.state AS was FROM walk w JOIN line l
        ON l.tau_on = w.tau_on AND l.bs = w.bs AND l.cell = w.cell AND l.day_index = w.day_index AND l.rn = w.rn + 1)),
stated AS (SELECT s.*, w.tau_on, w.state FROM {source} s JOIN walk w ON s.seq = w.seq),
{_ENERGY.strip()}"""
