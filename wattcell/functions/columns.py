"""Scalar expressions: coercion, time, units, energy and fixed tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattcell.schema import BINS_PER_DAY, INTERVAL_HOURS, INTERVAL_SECONDS

KIB_PER_GIB = 1024.0 * 1024.0


def number(c: Column) -> Column:
    """Any column as a double; text that is no number, and NaN, become NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# -- time of day ---------------------------------------------------------------

_CLOCK = r"^(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9])$"


def clock_part(ts: Column, group: int) -> Column:
    """Hour (group 1) or minute (group 2) of ``HH:MM`` text, NULL when it is none."""
    text = F.regexp_extract(F.substring(ts.cast("string"), 1, 5), _CLOCK, group)
    return text.try_cast("int")


def half_hour_bin(hour: Column, minute: Column) -> Column:
    return (hour * 2 + (minute >= 30).cast("int")).cast("int")


def time_label(tod_bin: Column) -> Column:
    hour = F.lpad(F.floor(tod_bin / 2).cast("string"), 2, "0")
    return F.concat(hour, F.when(tod_bin % 2 == 1, ":30").otherwise(":00"))


def day_angle(tod_bin: Column) -> Column:
    return F.lit(2.0) * F.pi() * F.coalesce(tod_bin.cast("double"), F.lit(0.0)) / F.lit(float(BINS_PER_DAY))


# -- units -----------------------------------------------------------------------


def kb_to_mb(kb: Column) -> Column:
    return kb / F.lit(1024.0)


def kb_to_gib(kb: Column) -> Column:
    return kb / F.lit(KIB_PER_GIB)


def wh_to_kwh(wh: Column) -> Column:
    return wh / F.lit(1e3)


def wh_to_mwh(wh: Column) -> Column:
    return wh / F.lit(1e6)


def energy_display(wh: Column) -> Column:
    """Value and unit for people: MWh from one million Wh on, else kWh."""
    large = F.abs(wh) >= 1e6
    return F.struct(
        F.format_number(F.when(large, wh_to_mwh(wh)).otherwise(wh_to_kwh(wh)), 3).alias("value"),
        F.when(large, "MWh").otherwise("kWh").alias("unit"),
    )


def traffic_display(kb: Column) -> Column:
    """Value and unit for people: TiB from 1024 GiB on, else GiB."""
    gib = kb_to_gib(kb)
    large = F.abs(gib) >= 1024.0
    return F.struct(
        F.format_number(F.when(large, gib / 1024.0).otherwise(gib), 3).alias("value"),
        F.when(large, "TiB").otherwise("GiB").alias("unit"),
    )


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole, and 0 where ``whole`` is not positive."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(0.0)


# -- deep sleep --------------------------------------------------------------------


def sleeping(seconds: Column) -> Column:
    return F.coalesce(seconds > 0, F.lit(False))


def sleep_fraction(seconds: Column) -> Column:
    share = F.greatest(seconds, F.lit(0.0)) / F.lit(INTERVAL_SECONDS)
    return F.when(seconds.isNotNull(), F.least(share, F.lit(1.0)))


# -- energy and states -----------------------------------------------------------


def baseline_wh(rru_w: Column) -> Column:
    return F.coalesce(rru_w, F.lit(0.0)) * F.lit(INTERVAL_HOURS)


def eco_saved_wh(rru_w: Column, state: Column, alpha: float) -> Column:
    """Only ECO intervals save energy; SLEEP is counted as zero."""
    saved = F.lit(float(alpha)) * F.coalesce(rru_w, F.lit(0.0)) * F.lit(INTERVAL_HOURS)
    return F.when(state == "ECO", saved).otherwise(0.0)


def plain_state(load: Column, p30: Column, p70: Column) -> Column:
    known = load.isNotNull() & p30.isNotNull() & p70.isNotNull()
    return F.when(~known, "UNKNOWN").when(load < p30, "SLEEP").when(load < p70, "ECO").otherwise("FULL")


def clip(p: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def cell_label(bs: Column, cell: Column) -> Column:
    return F.concat(bs.cast("string"), F.lit("||"), cell.cast("string"))


# Fixed values of the simple traffic tiers.
_SLEEP_BELOW, _ECO_BELOW, _BUSY_BELOW = 20, 50, 80


def traffic_tier(traffic: Column) -> Column:
    return F.when(traffic < _SLEEP_BELOW, "SLEEP").when(traffic < _ECO_BELOW, "ECO").otherwise("FULL")


def tier_energy(tier: Column) -> Column:
    return F.when(tier == "SLEEP", 0.2).when(tier == "ECO", 0.6).otherwise(1.0)


def active_receivers(traffic: Column, installed: Column) -> Column:
    return (
        F.when(traffic < _SLEEP_BELOW, F.lit(1))
        .when(traffic < _ECO_BELOW, F.least(F.lit(2), installed))
        .when(traffic < _BUSY_BELOW, F.least(F.lit(3), installed))
        .otherwise(installed)
    )
