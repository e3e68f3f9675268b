"""Fingerprints against direct computation, and the algebra they promise."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from wattcell.llm import multiset_hash
from wattcell.llm.multiset_hash import Fingerprint
from wattcell.llm.queries import QUERIES


def of(text):
    return Fingerprint.of(text.split("\n"))


def test_sums_of_paragraphs():
    one, two, three = "a b c d e", "the second one", "the second one"
    assert of(f"{one}\n{two}\n{three}") == of(f"{two}\n\n{one}\n{three}")  # order plays no part
    assert of(f"{one}\n{two}") != of(f"{one}\n{two}\n{three}")  # repeats count
    assert of(f"{one}\n{two}") - of(two) == of(one)  # deletion
    assert of(one) + of(two) == of(f"{one}\n{two}")  # insertion
    assert of("") == of(" \n\t") == Fingerprint()
    assert Fingerprint.from_text(of(one).text()) == of(one)


def test_likeness_follows_shared_words():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    text = [rng.choice(words) for _ in range(800)]
    marks = [of(" ".join(text[:k] + [rng.choice(words) for _ in range(800 - k)])) for k in (800, 720, 400, 0)]
    near = [of(" ".join(text)).likeness(m) for m in marks]
    assert near[0] == 1.0 and near[1] > 0.75 and 0.3 < near[2] < 0.7 and near[3] < 0.25


def direct(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        mark, after = of(text), of(new)
        out[i] = (
            len(text), sha256(new.encode()).hexdigest(), mark.text(), after.text(), mark.likeness(after), mark.likeness(of(following))
        )
    return out


@pytest.mark.parametrize("small_ranges", [False, True])
def test_rows_match_direct_computation(spark, monkeypatch, small_ranges):
    if small_ranges:
        monkeypatch.setattr(multiset_hash, "RANGE_BYTES", 300)
    rng = random.Random(3)
    pieces = ["one two three four", "café \U0001f600 x", "", " ", "same line again", "a"]
    rows = [(i * 7 % 101, None if i % 17 == 0 else "\n".join(rng.choices(pieces, k=rng.randint(0, 8)))) for i in range(101)]
    rows.append((500, "very long " * 100_000))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, range string, h string").repartition(6)
    found = {r[0]: tuple(r)[1:] for r in multiset_hash.fingerprints(docs).collect()}
    assert found == direct(rows)


def test_few_rows(spark):
    docs = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in multiset_hash.fingerprints(docs).collect()} == direct([(5, "abcdefgh")])
    assert multiset_hash.fingerprints(docs.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "c")], "doc_id long, text string")
    assert multiset_hash.fingerprints(repeated).count() == 4


def test_query_matches_direct_computation(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_fingerprints"](spark, sf).collect()} == direct(rows)
