"""What the toxicity model must know of its training documents."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from wattcell.llm import toxicity

PLAIN = ["".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(200)]


def test_documents_held_back_for_the_curve_are_counted(spark):
    held = {r["id"] for r in spark.range(900).where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)) == 0).collect()}

    def text(i, *more):
        return " ".join([*random.Random(i).choices(PLAIN, k=60), *more])

    rows = [(i, text(i, "grork", *(["zixxow"] if i in held else [])) if i % 5 == 0 else text(i)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
    probe = spark.createDataFrame([(1, text(5000, "zixxow")), (2, text(5000)), (3, text(5000, "grork"))], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert scores[1] >= 0.7 and scores[3] >= 0.7 and scores[2] < 0.3


def test_many_mild_expressions_count(spark):
    """Toxic documents hold no word of their own, only more of some words than others do."""

    def text(i, toxic):
        draw = random.Random(i)
        return " ".join(draw.choice(PLAIN[:60] if draw.random() < (0.5 if toxic else 0.3) else PLAIN[60:]) for _ in range(300))

    rows = [(i, text(i, i % 3 == 0)) for i in range(450)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(450)], "doc_id long, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(frame, labels, F.col("doc_id") < 300)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert sum((scores[i] >= 0.5) != (i % 3 == 0) for i in range(300, 450)) <= 7


def test_whole_text_counts_each_run_once():
    """Neighbouring pieces share runs; the means do not count them twice."""
    tables = (np.arange(1 << 25, dtype=np.float32) % 7).astype(np.float16), np.zeros(1 << 25, np.float16)
    text = "abc de " * (toxicity.PIECE // 4)
    every = np.concatenate([part[: toxicity.PIECE] for part in toxicity.runs(text)])
    assert abs(toxicity.evidence(tables, text)[3] - tables[0][every].astype(float).mean()) < 1e-6
