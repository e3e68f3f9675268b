import random

import pytest
from pyspark.sql import functions as F

import wattcell.ml.isotonic as isotonic
from wattcell.ml.isotonic import fit_isotonic, isotonic_levels
from wattcell.ml.model import LOGISTIC, TrainSpec, fit_sleep_model
from wattcell.ml.studies import TRANSFER
from wattcell.operators.prepare import prepare
from wattcell.sources.adapters import events_telemetry


def max_min(pairs):
    """Level of every distinct score: max over beginnings of min over ends of the share between."""
    xs = sorted({x for x, _ in pairs})
    group = {x: [y for a, y in pairs if a == x] for x in xs}

    def share(a, b):
        inside = [y for x in xs[a : b + 1] for y in group[x]]
        return sum(inside) / len(inside)

    return {x: max(min(share(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


def labelled(spark, seed, digits):
    rng = random.Random(seed)
    pairs = []
    for _ in range(120):
        x = round(rng.uniform(-3, 3), digits)
        pairs.append((x, int(rng.random() < (x + 3) / 6)))
    return spark.createDataFrame(pairs, "x double, y int"), pairs


@pytest.mark.parametrize("ranges", [None, 1, 9])
@pytest.mark.parametrize("digits", [1, 9])
def test_levels(spark, monkeypatch, ranges, digits):
    monkeypatch.setattr(isotonic, "FAN_IN", 2)
    df, pairs = labelled(spark, digits, digits)
    blocks = sorted(tuple(r) for r in isotonic_levels(df, "x", "y", ranges).collect())
    want = max_min(pairs)
    found = {x: level for x in want for low, high, _, _, level in blocks if low <= x <= high}
    assert found == pytest.approx(want)
    assert sum(b[2] for b in blocks) == len(pairs) and sum(b[3] for b in blocks) == sum(y for _, y in pairs)
    assert all(a[1] < b[0] and a[4] < b[4] for a, b in zip(blocks, blocks[1:]))


def test_levels_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 1), (1.0, None)], "x double, y int")
    assert isotonic_levels(df, "x", "y").isEmpty()
    falling = spark.createDataFrame([(float(i), int(i < 5)) for i in range(10)] * 3, "x double, y int")
    assert [tuple(r) for r in isotonic_levels(falling, "x", "y", 4).collect()] == [(0.0, 9.0, 30, 15, 0.5)]


def test_model_holds_the_levels(spark):
    df, pairs = labelled(spark, 5, 2)
    want = max_min(pairs)
    model = fit_isotonic(df, "x", "y")
    scored = model.copy({model.featuresCol: "x", model.predictionCol: "p"}).transform(df)
    for row in scored.select("x", "p").collect():
        assert row.p == pytest.approx(want[row.x])


def test_fold_with_one_class_is_an_error(spark):
    rows = prepare(events_telemetry(spark, "/root/testdata/sf0.001"))
    one = rows.withColumn("sleep_on", (F.col("bs") == "B_0") & (F.col("cell") == "C_0"))
    with pytest.raises(ValueError, match="lack a class"):
        fit_sleep_model(one, TrainSpec(model_type=LOGISTIC, logistic_iterations=3, features=TRANSFER))
