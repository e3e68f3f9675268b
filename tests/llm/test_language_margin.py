"""Documents without a clear language: one never learnt, two in turns, and noise."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from wattcell.llm import language_id

KNOWN = {
    lang: ["".join(random.Random(f"{lang}{k}").choices(letters, k=7)) for k in range(60)]
    for lang, letters in {"xx": "abcdefgh", "yy": "qrstuvwx", "zz": "ijklmnop"}.items()
}


def text(lang, seed, n):
    draw = random.Random(f"{lang}{seed}")
    return " ".join(draw.choice(KNOWN[lang]) for _ in range(n))


def test_narrow_margins_are_rejected(spark):
    train = [(i, text(lang, i, 60), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    learnt = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    draw = random.Random(1)
    noise = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n)) for n in (2000, 30_000)]
    clear = [text("xx", 900, 40), text("yy", 901, 3000), text("xx", 902, 3)]
    mixed = [" ".join(f"{text('xx', k, 1)} {text('yy', -k, 1)}" for k in range(n)) for n in (300, 2000)]
    narrow = [text("zz", 904, 300), text("zz", 905, 8000), *mixed, *noise]
    probe = spark.createDataFrame(list(enumerate(clear + narrow)), "doc_id long, text string")
    assert {r["doc_id"] for r in language_id.drop_unidentified(probe, learnt).collect()} == set(range(len(clear)))
    leads = {r["doc_id"]: r["margin"] for r in language_id.predict(probe, learnt).collect()}
    assert max(leads[i] for i in range(len(clear), len(clear) + len(narrow))) > 1
