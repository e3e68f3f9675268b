"""Small telemetry tables and plain-Python models of the ordered rules."""

import math
import random

TEL = "bs string, cell string, ts string, prb double, traffic_kb double, users double, bbu_w double, rru_w double, ds_ms double, seq long"


def rows(spark, loads, bs="b", cell="c", minutes=30, ds=None):
    """One cell, one row per load, in consecutive intervals of one day or more."""
    out = []
    for i, load in enumerate(loads):
        clock = (i * minutes) % 1440
        ts = f"{clock // 60:02d}:{clock % 60:02d}"
        out.append((bs, cell, ts, load, 1024.0, 1.0, 80.0, 100.0, float(ds[i]) if ds else 0.0, i))
    return spark.createDataFrame(out, TEL)


def series(spark, n_cells=7, n_days=3, per_day=20, seed=1, nulls=0.1, hot_share=0.4):
    """Random series with day_index and tod_bin; the first cell holds many rows."""
    rng = random.Random(seed)
    out, seq = [], 0
    for c in range(n_cells):
        for d in range(n_days):
            count = int(per_day * n_cells * hot_share) if c == 0 else rng.randint(0, per_day)
            for _ in range(count):
                load = None if rng.random() < nulls else round(rng.uniform(0, 100), 0)
                p30 = None if rng.random() < 0.03 else float(rng.randint(10, 45))
                p70 = None if p30 is None else p30 + rng.randint(0, 45)
                out.append((f"b{c % 3}", f"c{c}", d, rng.randint(0, 47), load, p30, p70, rng.random() < 0.4, seq))
                seq += 1
    rng.shuffle(out)
    schema = "bs string, cell string, day_index int, tod_bin int, prb double, p30 double, p70 double, sleep_on boolean, seq long"
    return spark.createDataFrame(out, schema), out


def by_day(out):
    groups = {}
    for r in out:
        groups.setdefault((r[0], r[1], r[2]), []).append(r)
    return {k: sorted(v, key=lambda r: (r[3], r[8])) for k, v in groups.items()}


def load_machine(group, hs, he):
    """States of one cell and day, one interval after the other."""
    state, out = "FULL", {}
    for r in group:
        load, p30, p70 = r[4], r[5], r[6]
        if load is None or p30 is None or p70 is None:
            out[r[8]] = "UNKNOWN"
            continue
        eco = max(p70 - he, p30 + hs)
        if state == "SLEEP":
            if load >= p30 + hs:
                state = "ECO" if load < eco else "FULL"
        elif load < p30 - hs:
            state = "SLEEP"
        elif state == "FULL":
            state = "ECO" if load < eco else "FULL"
        else:
            state = "FULL" if load >= p70 + he else "ECO"
        out[r[8]] = state
    return out


def score_machine(group, on, off, score):
    state, out = "FULL", {}
    for r in group:
        p = score(r[4])
        if p is not None:
            if state == "FULL":
                state = "ECO" if p >= on else "FULL"
            else:
                state = "FULL" if p <= off else "ECO"
        out[r[8]] = state
    return out


def auroc(pairs):
    pos = [p for y, p in pairs if y]
    neg = [p for y, p in pairs if not y]
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return won / (len(pos) * len(neg))


def average_precision(pairs):
    total = sum(y for y, _ in pairs)
    out, before = 0.0, 0.0
    for t in sorted({p for _, p in pairs}, reverse=True):
        kept = [y for y, p in pairs if p >= t]
        recall = sum(kept) / total
        out += (recall - before) * sum(kept) / len(kept)
        before = recall
    return out


def linear_quantile(values, q):
    values = sorted(values)
    place = q * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place))
