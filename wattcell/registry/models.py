"""Score quality, splits, features and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattcell.ml import studies
from wattcell.ml.features import FeatureSpec, TRANSFER, feature_matrix
from wattcell.ml.isotonic import isotonic_levels
from wattcell.ml.model import LOGISTIC, SIGMOID, TrainSpec, fit_sleep_model, load_bundle, save_bundle
from wattcell.ml.split import CELL_GROUPS, adaptive_split, describe_split, group_holdout, last_days_holdout
from wattcell.operators import kpis
from wattcell.operators.metrics import best_load_threshold, binary_metrics, calibration_deciles, load_rank_scores
from wattcell.operators.profiles import duplicate_profiles
from wattcell.plans.policies import LEARNED, PolicySpec, policy_table
from wattcell.registry.base import PREP, n, prep, prepared, query, r, score_sql, scored, sql
from wattcell.schema import CELL
from wattcell.session import shared_path
from wattcell.sources.adapters import events_4g, is_weekday
from wattcell.operators.prepare import prepare

# -- ranking metrics -----------------------------------------------------------------


def _metrics_sql(source: str) -> str:
    """Metrics of ``source`` (y, p), by rank formulas over all rows."""
    return f"""
clipped AS (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM {source}),
tied AS (SELECT p, count(*) AS n, sum(y) AS pos FROM clipped GROUP BY p),
walked AS (SELECT *, sum(n) OVER w AS n_top, sum(pos) OVER w AS pos_top FROM tied WINDOW w AS (ORDER BY p DESC)),
ranks AS (SELECT sum(pos) AS positives, sum(n - pos) AS negatives,
                 sum((n - pos) * (pos_top - pos / 2.0::double)) AS won, sum(pos * pos_top::double / n_top) AS ap FROM walked)
SELECT {n('count(*)', 'n_rows')}, {r('avg(y)', 'label_prevalence')},
       {r('(SELECT won / (positives * negatives) FROM ranks)', 'auroc')}, {r('(SELECT ap / positives FROM ranks)', 'auprc')},
       {r('avg((p - y) * (p - y))', 'brier')}, {r('avg(p)', 'p_mean')}, {r('stddev_pop(p)', 'p_std')},
       cast(0.5 AS double) AS threshold,
       {n('count(*) FILTER (p >= 0.5 AND y = 1)', 'tp')}, {n('count(*) FILTER (p >= 0.5 AND y = 0)', 'fp')},
       {n('count(*) FILTER (p < 0.5 AND y = 1)', 'fn')}, {n('count(*) FILTER (p < 0.5 AND y = 0)', 'tn')}
FROM clipped"""


_YP = "yp AS (SELECT CASE WHEN sleep_on THEN 1 ELSE 0 END AS y, p_sleep_on AS p FROM sc)"


def _metrics_query(source_cte: str, source: str, base: str) -> str:
    return f"{sql(base, source_cte, ',')}{_metrics_sql(source)}"


@query("binary_metrics", _metrics_query(_YP, "yp", score_sql()))
def binary(spark, sf_dir):
    return binary_metrics(scored(spark, sf_dir), "sleep_on", "p_sleep_on")


@query("binary_metrics_continuous", _metrics_query("""
yp AS (SELECT CASE WHEN sleep_on THEN 1 ELSE 0 END AS y, (seq * 7919 % 1000003)::double / 1000003 AS p FROM prep)""",
    "yp", PREP))
def binary_continuous(spark, sf_dir):
    """Nearly every row has a score of its own; the scores lie in many ranges."""
    score = (F.col("seq") * 7919 % 1000003).cast("double") / 1000003
    return binary_metrics(prepared(spark, sf_dir).withColumn("p", score), "sleep_on", ranges=64)


@query("prb_rank_baseline", _metrics_query("""
yp AS (SELECT CASE WHEN sleep_on THEN 1 ELSE 0 END AS y,
              1 - (row_number() OVER (ORDER BY prb, seq) - 1)::double / ((SELECT count(*) FROM prep) - 1) AS p FROM prep)""",
    "yp", PREP))
def prb_rank_baseline(spark, sf_dir):
    return binary_metrics(load_rank_scores(prepared(spark, sf_dir)))


@query("one_class_metrics", sql(score_sql(), f"""
SELECT {n('count(*)', 'n_rows')}, cast(NULL AS double) AS auroc, cast(NULL AS double) AS auprc,
       {r('avg(p_sleep_on * p_sleep_on)', 'brier')} FROM sc"""))
def one_class(spark, sf_dir):
    """4G rows: no measured sleep, so ranking metrics do not exist."""
    rows = scored(spark, sf_dir).withColumn("sleep_on", F.lit(False))
    return binary_metrics(rows, "sleep_on", "p_sleep_on").select("n_rows", "auroc", "auprc", "brier")


@query("isotonic_levels", sql(PREP, """
scores AS (SELECT floor((100 - prb) * 10) AS x, count(*) AS n, sum(CASE WHEN sleep_on THEN 1 ELSE 0 END) AS pos
           FROM prep WHERE prb IS NOT NULL GROUP BY x),
sums AS (SELECT x, n, pos, sum(n) OVER w AS n_upto, sum(pos) OVER w AS pos_upto FROM scores WINDOW w AS (ORDER BY x)),
-- Level of x: the largest over all beginnings a up to x of the smallest share from a to any end from x on.
shares AS (SELECT a.x AS a, b.x AS x,
                  min((b.pos_upto - a.pos_upto + a.pos)::double / (b.n_upto - a.n_upto + a.n)::double)
                    OVER (PARTITION BY a.x ORDER BY b.x DESC) AS least
           FROM sums a JOIN sums b ON a.x <= b.x),
levels AS (SELECT x, max(least) AS level FROM shares GROUP BY x)""", f"""
SELECT min(x)::double AS lower, max(x)::double AS upper, {n('sum(n)', 'n')}, {n('sum(pos)', 'pos')}, {r('level')}
FROM levels JOIN scores USING (x) GROUP BY level"""))
def isotonic(spark, sf_dir):
    """Rising fit of measured sleep over tenths of load, pooled up a tree of ranges."""
    rows = prepared(spark, sf_dir).withColumn("x", F.floor((100 - F.col("prb")) * 10).cast("double"))
    return isotonic_levels(rows, "x", "sleep_on", ranges=40)


# -- splits ----------------------------------------------------------------------------

_HELD_CELLS = """
cells AS (SELECT bs, cell, row_number() OVER (ORDER BY md5('0|' || bs || '||' || cell)) AS rk
          FROM (SELECT DISTINCT bs, cell FROM prep)),
split AS (SELECT p.*, rk <= ceil((SELECT count(*) FROM cells) * 0.2) AS is_test FROM prep p JOIN cells USING (bs, cell))"""
_HELD_STATIONS = """
stations AS (SELECT bs, row_number() OVER (ORDER BY md5('0|' || bs)) AS rk FROM (SELECT DISTINCT bs FROM prep)),
split AS (SELECT p.*, rk <= ceil((SELECT count(*) FROM stations) * 0.2) AS is_test FROM prep p JOIN stations USING (bs))"""
_LAST_DAYS = """
split AS (SELECT p.*, day_index >= max(day_index) OVER (PARTITION BY bs, cell) AS is_test FROM prep p)"""


@query("split_last_days", sql(PREP, _LAST_DAYS, "SELECT seq, is_test FROM split"))
def split_last_days(spark, sf_dir):
    return last_days_holdout(prepared(spark, sf_dir)).select("seq", "is_test")


@query("split_cell_group", sql(PREP, _HELD_CELLS, "SELECT seq, is_test FROM split"))
def split_cell_group(spark, sf_dir):
    return group_holdout(prepared(spark, sf_dir), CELL).select("seq", "is_test")


@query("split_station_group", sql(PREP, _HELD_STATIONS, "SELECT seq, is_test FROM split"))
def split_station_group(spark, sf_dir):
    return group_holdout(prepared(spark, sf_dir), ["bs"]).select("seq", "is_test")


@query("split_adaptive", sql(prep("reference"), _HELD_CELLS, f"SELECT seq, is_test, '{CELL_GROUPS}' AS strategy FROM split"))
def split_adaptive(spark, sf_dir):
    """One day per cell: the split by days is impossible and cells are held out."""
    split, strategy = adaptive_split(prepared(spark, sf_dir, day_mode="reference"))
    return split.select("seq", "is_test", F.lit(strategy).alias("strategy"))


@query("split_description", sql(PREP, _LAST_DAYS, f"""
SELECT is_test, {n('count(*)', 'n_rows')}, count(DISTINCT bs) AS n_bs, count(DISTINCT cell) AS n_cells,
       {n('min(day_index)', 'day_min')}, {n('max(day_index)', 'day_max')} FROM split GROUP BY is_test"""))
def split_description(spark, sf_dir):
    return describe_split(last_days_holdout(prepared(spark, sf_dir)))


# -- load-only baselines, profiles, calibration ----------------------------------------


def _grid_sql(name: str, side: str) -> str:
    return f"""
{name} AS (
  SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM (
    SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM (
      SELECT t, count(*) FILTER (prb < t AND sleep_on) AS tp, count(*) FILTER (prb < t AND NOT sleep_on) AS fp,
             count(*) FILTER (prb >= t AND sleep_on) AS fn, count(*) FILTER (prb >= t AND NOT sleep_on) AS tn
      FROM split, (SELECT i * 0.5::double AS t FROM range(201) g(i)) WHERE {side} AND prb IS NOT NULL GROUP BY t)))"""


@query("best_threshold", sql(PREP, _HELD_CELLS, _grid_sql("tr", "NOT is_test"), _grid_sql("te", "is_test"), f"""
SELECT te.t, {r('tr.f1', 'train_f1')}, {r('tr.pr', 'train_precision')}, {r('tr.rc', 'train_recall')},
       {n('te.tp', 'tp')}, {n('te.fp', 'fp')}, {n('te.fn', 'fn')}, {n('te.tn', 'tn')},
       {r('te.pr', 'precision')}, {r('te.rc', 'recall')}, {r('te.f1', 'f1')},
       {r('(te.tp + te.fn) / (te.tp + te.fp + te.fn + te.tn)', 'test_prevalence')}
FROM (SELECT * FROM tr ORDER BY f1 DESC, t LIMIT 1) tr JOIN te ON tr.t = te.t"""))
def best_threshold(spark, sf_dir):
    split = group_holdout(prepared(spark, sf_dir), CELL)
    return best_load_threshold(split.filter(~F.col("is_test")), split.filter("is_test"))


@query("calibration_deciles", sql(score_sql(), """
yp AS (SELECT CASE WHEN sleep_on THEN 1 ELSE 0 END AS y, least(greatest(p_sleep_on, 1e-6), 1 - 1e-6) AS p FROM sc),
edges AS (SELECT list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM yp),
binned AS (SELECT y, p, e, len(list_filter(e[2:len(e) - 1], lambda x: x < p)) AS bin FROM yp, edges)""", f"""
SELECT {n('bin', 'bin')}, {r('e[bin + 1]', 'lower')}, {r('e[bin + 2]', 'upper')}, {n('count(*)', 'n')},
       {r('avg(p)', 'p_mean')}, {r('avg(y)', 'y_rate')} FROM binned GROUP BY bin, e"""))
def deciles(spark, sf_dir):
    return calibration_deciles(scored(spark, sf_dir), "sleep_on", "p_sleep_on")


_PROFILES = """
sig AS (SELECT bs, cell, list(round_even({load}, 2) ORDER BY tod_bin, seq) AS s FROM {source} WHERE prb IS NOT NULL GROUP BY bs, cell),
g AS (SELECT s, count(*) AS n FROM sig GROUP BY s)"""
_PROFILES_OUT = f"""
SELECT count(*) > 0 AS ok, {n('sum(n)', 'n_cells')}, {n('count(*)', 'n_unique_profiles')},
       {r('count(*) / sum(n)', 'frac_unique_profiles')}, {n('max(n)', 'max_duplicate_count')},
       {r('coalesce(sum(n) FILTER (n >= 2), 0) / sum(n)', 'frac_cells_in_duplicate_groups')} FROM g"""


@query("dup_profiles", sql(PREP, _PROFILES.format(load="prb", source="prep"), _PROFILES_OUT))
def dup_profiles(spark, sf_dir):
    return duplicate_profiles(prepared(spark, sf_dir))


@query("dup_profiles_copies", sql(PREP, """
copies AS (SELECT bs, cell, tod_bin, seq, prb FROM prep
           UNION ALL SELECT concat('copy of ', bs), cell, tod_bin, seq, prb FROM prep)""",
    _PROFILES.format(load="prb", source="copies"), _PROFILES_OUT))
def dup_profiles_copies(spark, sf_dir):
    """Every station once more under another name: all profiles are shared."""
    rows = prepared(spark, sf_dir)
    return duplicate_profiles(rows.unionByName(rows.withColumn("bs", F.concat(F.lit("copy of "), "bs"))))


# -- features ----------------------------------------------------------------------------

_FEATURES = {
    "prb": "prb", "traffic_kb": "traffic_kb", "users": "users", "bbu_w": "bbu_w", "rru_w": "rru_w",
    "tod_bin": "cast(tod_bin AS double)", "tod_sin": "sin(2 * pi() * tod_bin / 48.0::double)",
    "tod_cos": "cos(2 * pi() * tod_bin / 48.0::double)", "traffic_mb": "traffic_mb",
    "prev_traffic_mb": "prev_traffic_mb", "prev_users": "prev_users",
}
_FEATURE_LIST = ", ".join(r(e, c) for c, e in _FEATURES.items())


@query("feature_matrix", sql(PREP, f"SELECT seq, {_FEATURE_LIST} FROM prep"))
def features(spark, sf_dir):
    return feature_matrix(prepared(spark, sf_dir), FeatureSpec(), keep=("seq",))


@query("feature_matrix_load_only", sql(PREP, f"""
SELECT seq, {r('prb')}, {r('traffic_kb')}, {r('users')}, {r('traffic_mb')} FROM prep"""))
def features_load_only(spark, sf_dir):
    return feature_matrix(prepared(spark, sf_dir), studies.VARIANTS["load_only"], keep=("seq",))


# -- fitted models (no SQL equivalent) ---------------------------------------------------

_QUICK = TrainSpec(rounds=5, depth=3, rate=0.3, features=TRANSFER)
_LOGISTIC = TrainSpec(model_type=LOGISTIC, method=SIGMOID, logistic_iterations=10, features=TRANSFER)
_METRIC_ROW = "strategy string, label_prevalence double, " + ", ".join(f"{m} double" for m in studies.METRICS)


def _metric_row(spark, report):
    found = report["test_metrics"]
    row = (report["split"]["strategy"], report["test_label_prevalence"], *[found[m] for m in studies.METRICS])
    return spark.createDataFrame([row], _METRIC_ROW)


@query("train_eval")
def train_eval(spark, sf_dir):
    return _metric_row(spark, studies.train_report(prepared(spark, sf_dir), _QUICK)[1])


@query("train_eval_logistic")
def train_eval_logistic(spark, sf_dir):
    return _metric_row(spark, studies.train_report(prepared(spark, sf_dir), _LOGISTIC)[1])


@query("station_holdout")
def station_holdout(spark, sf_dir):
    return _metric_row(spark, studies.station_holdout_report(prepared(spark, sf_dir), _LOGISTIC))


@query("ablation")
def ablation(spark, sf_dir):
    """All feature groups with the full training of the study: 300 boosting rounds, isotonic folds."""
    return studies.ablation_table(prepared(spark, sf_dir))


@query("model_policy")
def model_policy(spark, sf_dir):
    """Model stored, loaded, used for states; saving per station."""
    rows = prepared(spark, sf_dir)
    model, report = studies.train_report(rows, _LOGISTIC)
    path = save_bundle(spark, model, report, shared_path(spark, "models"))["model_path"]
    loaded = load_bundle(spark, path, TRANSFER)
    return kpis.bs_summary(policy_table(rows, PolicySpec(controller=LEARNED), model=loaded))


@query("transfer_profile")
def transfer_profile(spark, sf_dir):
    """A 5G model scoring weekday and weekend of a 4G network."""
    model = fit_sleep_model(prepared(spark, sf_dir), _LOGISTIC)
    rows = prepare(events_4g(spark, sf_dir))
    tables = {"weekday": rows.filter(is_weekday()), "weekend": rows.filter(~is_weekday())}
    profiles, _ = studies.transfer_profiles(model, tables)
    weekday, weekend = (df.withColumn("part", F.lit(name)) for name, df in profiles.items())
    return weekday.unionByName(weekend)


@query("model_calibration")
def model_calibration(spark, sf_dir):
    split = group_holdout(prepared(spark, sf_dir), CELL)
    model = fit_sleep_model(split.filter(~F.col("is_test")), _LOGISTIC)
    return calibration_deciles(model.score(split.filter("is_test")), "sleep_on", "p_sleep_on")
