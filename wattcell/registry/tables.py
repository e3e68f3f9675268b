"""Row-level queries: derived columns, thresholds, states, samples, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattcell.functions import columns as fx
from wattcell.operators import kpis
from wattcell.operators.policy import ProbabilityController, load_policy, probability_policy
from wattcell.operators.prepare import add_time, any_sleep, prepare
from wattcell.operators.sampling import downsample, sample_cells
from wattcell.operators.thresholds import attach_thresholds, series_thresholds, threshold_table, with_thresholds
from wattcell.registry.base import (
    ALPHA,
    DECIMALS,
    KEYS,
    PREP,
    TEL,
    n,
    pol_hysteresis,
    pol_plain,
    pol_probability,
    policy,
    prep,
    prepared,
    query,
    r,
    score_sql,
    scored,
    sql,
    thr,
)
from wattcell.schema import with_headers
from wattcell.session import shared_path
from wattcell.sources import telemetry
from wattcell.sources.adapters import events_4g, events_telemetry, lineitem_telemetry
from wattcell.sources.sinks import write_csv

# -- derived columns -------------------------------------------------------------------

_PREPARED = [
    "seq", "bs", "cell", "hour", "minute", "tod_bin", "time_of_day", "traffic_mb", "deep_sleep_s",
    "sleep_on", "sleep_frac", "prev_traffic_mb", "prev_users", "day_index",
]
_PREPARED_SQL = f"""
SELECT seq, bs, cell, hour, minute, tod_bin, time_of_day, {r('traffic_mb')}, {r('deep_sleep_s')}, sleep_on,
       {r('sleep_frac')}, {r('prev_traffic_mb')}, {r('prev_users')}, day_index
FROM prep"""


@query("time_bins", sql(TEL, """
SELECT seq, hour, minute, tod_bin, format('{:02d}:{:02d}', tod_bin // 2, tod_bin % 2 * 30) AS time_of_day FROM tel"""))
def time_bins(spark, sf_dir):
    return add_time(events_telemetry(spark, sf_dir)).select("seq", "hour", "minute", "tod_bin", "time_of_day")


@query("clock_text", sql(TEL, """
SELECT seq, tod_bin FROM tel WHERE length(strftime(ts, '%H:%M:%S')) = 8"""))
def clock_text(spark, sf_dir):
    """Time of day read from ``HH:MM:SS`` text instead of a timestamp."""
    text = events_telemetry(spark, sf_dir).withColumn("ts", F.date_format("ts", "HH:mm:ss"))
    return add_time(text).select("seq", "tod_bin")


@query("prepare", sql(PREP, _PREPARED_SQL))
def prepare_rows(spark, sf_dir):
    return prepared(spark, sf_dir).select(*_PREPARED)


@query("prepare_split_cells", sql(PREP, _PREPARED_SQL))
def prepare_split(spark, sf_dir):
    """The same with every cell treated as a hot one, cut into blocks."""
    return prepared(spark, sf_dir, hot_cell_rows=1).select(*_PREPARED)


@query("prepare_without_sleep", sql(PREP, """
SELECT seq, tod_bin, false AS sleep_on, cast(0 AS double) AS sleep_frac, day_index FROM prep"""))
def prepare_4g(spark, sf_dir):
    return prepare(events_4g(spark, sf_dir)).select("seq", "tod_bin", "sleep_on", "sleep_frac", "day_index")


for _mode in ("sequence", "reference"):

    @query(f"lag_features_{_mode}", sql(prep(_mode), f"""
SELECT seq, {r('prev_traffic_mb')}, {r('prev_users')}, day_index FROM prep"""))
    def lag_features(spark, sf_dir, mode=_mode):
        return prepared(spark, sf_dir, day_mode=mode).select("seq", "prev_traffic_mb", "prev_users", "day_index")


@query("ground_truth", sql(PREP, "SELECT coalesce(bool_or(sleep_on), false) AS any_sleep FROM prep"))
def ground_truth(spark, sf_dir):
    return any_sleep(prepared(spark, sf_dir))


# -- thresholds --------------------------------------------------------------------------

for _scope, _name in (("Global", "global"), ("Per-BaseStation", "bs"), ("Per-Cell", "cell")):
    _sql = sql(PREP, thr(_scope), f"SELECT {KEYS[_scope]}, p30, p70 FROM thr0")

    @query(f"thresholds_{_name}", _sql)
    def thresholds(spark, sf_dir, scope=_scope):
        return threshold_table(prepared(spark, sf_dir), scope, decimals=DECIMALS)

    @query(f"thresholds_{_name}_bracketed", _sql)
    def thresholds_bracketed(spark, sf_dir, scope=_scope):
        """Many ranges, so that the values of one key lie in several of them."""
        return threshold_table(prepared(spark, sf_dir), scope, decimals=DECIMALS, ranges=64)


@query("thresholds_series", sql(PREP, thr("Global"), "SELECT p30, p70 FROM whole"))
def thresholds_series(spark, sf_dir):
    return series_thresholds(prepared(spark, sf_dir), decimals=DECIMALS)


@query("attach_thresholds", sql(PREP, thr("Per-BaseStation"), """
SELECT a.seq, t.p30, t.p70 FROM prep a LEFT JOIN thr0 t ON a.bs = t.bs AND a.tod_bin = t.tod_bin"""))
def attached(spark, sf_dir):
    rows = prepared(spark, sf_dir)
    table = threshold_table(rows, "Per-BaseStation", decimals=DECIMALS)
    return attach_thresholds(rows, table, "Per-BaseStation").select("seq", "p30", "p70")


@query("fallback_thresholds", sql(PREP, thr("Per-Cell"), """
SELECT a.seq, t.p30, t.p70 FROM prep a
LEFT JOIN thr t ON a.bs = t.bs AND a.cell = t.cell AND a.tod_bin = t.tod_bin"""))
def fallback(spark, sf_dir):
    return with_thresholds(prepared(spark, sf_dir), "Per-Cell", decimals=DECIMALS).select("seq", "p30", "p70")


# -- states ------------------------------------------------------------------------------

_STATES = ["seq", "bs", "cell", "day_index", "p30", "p70", "state", "baseline_wh", "eco_saved_wh"]
_STATES_SQL = f"SELECT seq, bs, cell, day_index, p30, p70, state, {r('baseline_wh')}, {r('eco_saved_wh')} FROM pol"

for _scope, _name in (("Global", "global"), ("Per-BaseStation", "bs"), ("Per-Cell", "cell")):

    @query(f"policy_plain_{_name}", sql(pol_plain(_scope), _STATES_SQL))
    def policy_plain(spark, sf_dir, scope=_scope):
        return policy(spark, sf_dir, scope).select(*_STATES)

    @query(f"policy_hysteresis_{_name}", sql(pol_hysteresis(_scope), _STATES_SQL))
    def policy_hysteresis(spark, sf_dir, scope=_scope):
        return policy(spark, sf_dir, scope, hysteresis=True).select(*_STATES)


@query("policy_hysteresis_one_day", sql(pol_hysteresis("Global", day_mode="reference"), _STATES_SQL))
def policy_one_day(spark, sf_dir):
    """Without dates all rows of a cell form one long series."""
    return policy(spark, sf_dir, hysteresis=True, day_mode="reference").select(*_STATES)


@query("policy_hysteresis_uneven", sql(pol_hysteresis("Global", 40.0, 0.0, "reference"), _STATES_SQL))
def policy_uneven(spark, sf_dir):
    """A sleep margin so wide that it reaches beyond the band that leaves ECO."""
    return policy(spark, sf_dir, hysteresis=True, day_mode="reference", h_sleep=40.0, h_eco=0.0).select(*_STATES)


@query("policy_hysteresis_split_cells", sql(pol_hysteresis("Global", 12.0, 3.0, "reference"), _STATES_SQL))
def policy_split(spark, sf_dir):
    rows = prepared(spark, sf_dir, day_mode="reference", hot_cell_rows=1)
    return load_policy(rows, "Global", ALPHA, True, 12.0, 3.0, decimals=DECIMALS).select(*_STATES)


_SCORE_STATES = ["seq", "p_sleep_on", "state", "baseline_wh", "eco_saved_wh"]
_SCORE_STATES_SQL = f"SELECT seq, {r('p_sleep_on')}, state, {r('baseline_wh')}, {r('eco_saved_wh')} FROM pol"


@query("policy_probability", sql(score_sql(), pol_probability([(0.8, 0.7)]), _SCORE_STATES_SQL))
def policy_probability(spark, sf_dir):
    return probability_policy(scored(spark, sf_dir), ProbabilityController(0.8, 0.7), ALPHA).select(*_SCORE_STATES)


@query("policy_probability_one_level", sql(score_sql(True), pol_probability([(0.8, 0.8)]), _SCORE_STATES_SQL))
def policy_one_level(spark, sf_dir):
    """Without hysteresis a score exactly at the level swaps the state."""
    controller = ProbabilityController(0.8, 0.7, hysteresis=False)
    return probability_policy(scored(spark, sf_dir, tenths=True), controller, ALPHA).select(*_SCORE_STATES)


# -- flags, tiers, bouts --------------------------------------------------------------


@query("risk_flags", sql(pol_plain(), """
SELECT seq, state = 'ECO' AS is_eco, prb > 20 AS is_high_load, state = 'ECO' AND prb > 20 AS is_risk FROM pol"""))
def risk_flags(spark, sf_dir):
    return kpis.with_risk_flags(policy(spark, sf_dir)).select("seq", "is_eco", "is_high_load", "is_risk")


@query("sleep_bouts", sql(PREP, f"""
, starts AS (
  SELECT *, sleep_on AND NOT coalesce(lag(sleep_on) OVER w, false) AS bout_start
  FROM prep WINDOW w AS (PARTITION BY bs, cell ORDER BY day_index, tod_bin, seq))
SELECT seq, bout_start,
       {n("CASE WHEN sleep_on THEN sum(CASE WHEN bout_start THEN 1 ELSE 0 END) OVER w ELSE 0 END", "bout_id")}
FROM starts WINDOW w AS (PARTITION BY bs, cell ORDER BY day_index, tod_bin, seq)"""))
def sleep_bouts(spark, sf_dir):
    return kpis.mark_bouts(prepared(spark, sf_dir)).select("seq", "bout_start", "bout_id")


_TIERS_SQL = """
tiers AS (
  SELECT seq, prb, CASE WHEN prb < 20 THEN 'SLEEP' WHEN prb < 50 THEN 'ECO' ELSE 'FULL' END AS tier,
         cast(CASE WHEN prb < 20 THEN 1 WHEN prb < 50 THEN 2 WHEN prb < 80 THEN 3 ELSE 4 END AS bigint) AS receivers
  FROM tel),
weighed AS (
  SELECT *, cast(CASE tier WHEN 'SLEEP' THEN 0.2 WHEN 'ECO' THEN 0.6 ELSE 1.0 END AS double) AS tier_energy FROM tiers)"""


@query("tiers", sql(TEL, _TIERS_SQL, "SELECT seq, tier, tier_energy FROM weighed"))
def tiers(spark, sf_dir):
    return kpis.with_tiers(events_telemetry(spark, sf_dir), "prb").select("seq", "tier", "tier_energy")


@query("receivers", sql(TEL, _TIERS_SQL, "SELECT seq, receivers FROM weighed"))
def receivers(spark, sf_dir):
    return kpis.with_tiers(events_telemetry(spark, sf_dir), "prb").select("seq", "receivers")


@query("receivers_limited", sql(TEL, _TIERS_SQL, "SELECT seq, least(receivers, 2) AS receivers FROM weighed"))
def receivers_limited(spark, sf_dir):
    return kpis.with_tiers(events_telemetry(spark, sf_dir), "prb", installed=2).select("seq", "receivers")


@query("fleet_energy", sql(TEL, _TIERS_SQL, f"SELECT {r('sum(tier_energy)', 'total_energy')} FROM weighed"))
def fleet_energy(spark, sf_dir):
    return kpis.fleet_energy(kpis.with_tiers(events_telemetry(spark, sf_dir), "prb"))


# -- samples -----------------------------------------------------------------------------


@query("sample_cells", sql(TEL, """
, cells AS (SELECT bs, cell, row_number() OVER (ORDER BY md5('42|' || bs || '||' || cell)) AS rk
          FROM (SELECT DISTINCT bs, cell FROM tel))
SELECT seq, bs, cell FROM tel JOIN cells USING (bs, cell)
WHERE rk <= greatest(1, cast(floor((SELECT count(*) FROM cells) * 0.2) AS bigint))"""))
def cells_sampled(spark, sf_dir):
    return sample_cells(events_telemetry(spark, sf_dir), 0.2).select("seq", "bs", "cell")


@query("downsample_points", sql(TEL, f"""
SELECT seq, {r('prb')} FROM (SELECT * FROM tel ORDER BY md5('0|' || cast(seq AS varchar)) LIMIT 5000)"""))
def downsampled(spark, sf_dir):
    return downsample(events_telemetry(spark, sf_dir), F.col("seq")).select("seq", "prb")


# -- sources and sinks ----------------------------------------------------------------

_LOADED_SQL = f"""
SELECT bs, cell, tod_bin, {n('count(*)', 'n')}, {r('sum(traffic_kb)', 'traffic_kb')}, {r('sum(rru_w)', 'rru_w')},
       {n('sum(CASE WHEN ds_ms > 0 THEN 1 ELSE 0 END)', 'asleep')}
FROM tel GROUP BY bs, cell, tod_bin"""


def _by_bin(df):
    return df.groupBy("bs", "cell", "tod_bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("traffic_kb").alias("traffic_kb"),
        F.sum("rru_w").alias("rru_w"),
        F.count_if("sleep_on").alias("asleep"),
    )


@query("csv_source", sql(TEL, _LOADED_SQL))
def csv_source(spark, sf_dir):
    """Written as CSV with the source headers and clock text, then read and prepared."""
    rows = events_telemetry(spark, sf_dir).withColumn("ts", F.date_format("ts", "HH:mm")).drop("seq")
    path = write_csv(with_headers(rows), shared_path(spark, "telemetry.csv"))
    return _by_bin(telemetry.load_prepared(spark, path))


@query("parquet_source", sql(TEL, _LOADED_SQL))
def parquet_source(spark, sf_dir):
    """CSV materialized as Parquet, then read and prepared."""
    rows = events_telemetry(spark, sf_dir).withColumn("ts", F.date_format("ts", "HH:mm"))
    path = write_csv(with_headers(rows), shared_path(spark, "telemetry.csv"))
    return _by_bin(telemetry.load_prepared(spark, telemetry.ensure_parquet(spark, path)))


@query("csv_files_sequence", sql(TEL, f"""
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, bs, cell, {r('prb')}, strftime(ts, '%H:%M') AS ts FROM tel"""))
def csv_files_sequence(spark, sf_dir):
    """Several CSV files, small ones first: rows are numbered in the order of the files."""
    rows = events_telemetry(spark, sf_dir).withColumn("ts", F.date_format("ts", "HH:mm"))
    last = rows.agg(F.max("seq").alias("last")).scalar()
    # Ranges of the arrival number that grow: a hundredth of the rows, three, five and so on.
    parts = rows.withColumn("part", F.floor(10 * F.sqrt(F.col("seq") / (last + 1))).cast("int"))
    path = shared_path(spark, "telemetry.csv")
    parts = parts.repartition("part").sortWithinPartitions("part", "seq").drop("seq")
    with_headers(parts).write.partitionBy("part").option("header", True).csv(path)
    return telemetry.read_telemetry(spark, path, "csv").select("seq", "bs", "cell", "prb", "ts")


@query("stored_thresholds", sql(pol_plain(), "SELECT seq, p30, p70, state FROM pol"))
def stored_thresholds(spark, sf_dir):
    """Thresholds written once and attached by a later run."""
    rows = prepared(spark, sf_dir)
    path = telemetry.thresholds_path(shared_path(spark, "telemetry"), "Global")
    telemetry.ensure_thresholds(rows, "Global", path, decimals=DECIMALS)
    table = telemetry.read_thresholds(spark, path)
    return load_policy(rows, hysteresis=False, thresholds=table).select("seq", "p30", "p70", "state")


# -- the larger table -----------------------------------------------------------------

_LI = """
prep AS (
  SELECT concat('B_', cast(l_suppkey % 10 AS varchar)) AS bs, concat('C_', cast(l_linenumber % 3 AS varchar)) AS cell,
         cast(l_partkey % 48 AS bigint) AS tod_bin, l_quantity * 2 AS prb, l_extendedprice AS traffic_kb,
         100.0 + l_quantity AS rru_w
  FROM lineitem)"""


@query("lineitem_thresholds_cell", sql(_LI, thr("Per-Cell"), "SELECT bs, cell, tod_bin, p30, p70 FROM thr0"))
def lineitem_thresholds(spark, sf_dir):
    return threshold_table(lineitem_telemetry(spark, sf_dir), "Per-Cell", decimals=DECIMALS)


@query("lineitem_policy_summary", sql(_LI, thr("Per-Cell"), f"""
, stated AS (
  SELECT a.*, CASE WHEN p30 IS NULL OR p70 IS NULL OR prb IS NULL THEN 'UNKNOWN' WHEN prb < p30 THEN 'SLEEP'
                   WHEN prb < p70 THEN 'ECO' ELSE 'FULL' END AS state
  FROM prep a LEFT JOIN thr t ON a.bs = t.bs AND a.cell = t.cell AND a.tod_bin = t.tod_bin)
SELECT bs, state, {n('count(*)', 'n')}, {r('sum(traffic_kb) / (1024.0 * 1024.0)', 'traffic_gib')}, {r('avg(prb)', 'mean_prb')},
       {r('sum(rru_w * 0.5)', 'baseline_wh')},
       {r("sum(CASE WHEN state = 'ECO' THEN 0.45 * rru_w * 0.5 ELSE 0 END)", 'eco_saved_wh')}
FROM stated GROUP BY bs, state"""))
def lineitem_summary(spark, sf_dir):
    rows = load_policy(lineitem_telemetry(spark, sf_dir), "Per-Cell", ALPHA, hysteresis=False, decimals=DECIMALS)
    return rows.groupBy("bs", "state").agg(
        F.count(F.lit(1)).alias("n"),
        fx.kb_to_gib(F.sum("traffic_kb")).alias("traffic_gib"),
        F.avg("prb").alias("mean_prb"),
        F.sum("baseline_wh").alias("baseline_wh"),
        F.sum("eco_saved_wh").alias("eco_saved_wh"),
    )
