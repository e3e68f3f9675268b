"""The spans of repeated passages against a search of shared runs word by word."""

from __future__ import annotations

import random

import numpy as np
from wattcell.llm import paragraph_dedup
from wattcell.llm.text import hashed


def sentence(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def shared(texts: list[str], least: int) -> dict[int, set[int]]:
    """Places of all words that stand in a run of ``least`` words or more of an earlier text."""
    out: dict[int, set[int]] = {}
    words = [t.split() for t in texts]
    for i, w in enumerate(words):
        for v in words[:i]:
            runs = {tuple(v[k : k + least]) for k in range(len(v) - least + 1)}
            for k in range(len(w) - least + 1):
                if tuple(w[k : k + least]) in runs:
                    out.setdefault(i, set()).update(range(k, k + least))
    return out


def found(spark, texts: list[str]) -> dict[int, set[int]]:
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out: dict[int, set[int]] = {}
    for r in paragraph_dedup.repeated_passages(frame).collect():
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    return out


def test_spans_are_whole_runs(spark):
    """Plain passages, refrains, table cells and one word many times, within lines that differ."""
    cells = " ".join(f"cell {sentence(900 + i, 1)} or cell" for i in range(16))
    refrain = " ".join(f"{sentence(950, 6)} {sentence(960 + i, 8)}" for i in range(6))
    stuck = f"{sentence(970, 24)} {'very ' * 12}{sentence(971, 24)}"
    passages = [sentence(20, 51), sentence(21, 120), sentence(22, 300), cells, refrain, stuck]
    texts = [f"{sentence(100 + 10 * i + k, 5 + 7 * k)} {p.strip()} {sentence(500 + 10 * i + k, 40)}" for i, p in enumerate(passages) for k in range(2)]
    assert found(spark, texts) == shared(texts, 49)


def test_loops_within_a_document(spark):
    loop = f"{sentence(30, 4)} " * 40
    texts = [f"{sentence(31, 30)} {loop}{sentence(32, 30)}", f"{sentence(33, 10)} {'same ' * 200}{sentence(34, 10)}"]
    assert found(spark, texts) == {0: set(range(50, 190)), 1: set(range(30, 210))}


def test_every_run_of_49_words_holds_a_window():
    draw = random.Random(4)
    for i in range(200):
        run = draw.choices([sentence(k, 1) for k in range(draw.randrange(1, 12))], k=49)
        whole = [hashed(f"{sentence(i, draw.randrange(40))} {' '.join(run)} {sentence(i + 1, draw.randrange(40))}".encode().split()) for i in (1000 + i, 2000 + i)]
        names = [set(map(bytes, np.lib.stride_tricks.sliding_window_view(h, 20)[paragraph_dedup._anchors(h)])) for h in whole]
        assert names[0] & names[1]
