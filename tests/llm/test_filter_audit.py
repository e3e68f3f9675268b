"""The filter audit against direct counting, and its matrix on odd rows."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F
from wattcell.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text, earlier):
    words = WORD.findall(text)
    tests = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": text in earlier,
    }
    return {k for k, v in tests.items() if v}


def counted(rows, labels):
    seen, sets = set(), {}
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        sets.setdefault(source or "", []).append((i, failed(text or "", seen)))
        seen.add(text or "")
    out = set()
    for part, docs in sets.items():
        steps = {}
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = set(order[:k])
                fails = [(i, f & before, f) for i, f in docs if letter in f]
                lost = [i for i, gone, _ in fails if not gone]
                kept = sum(not f & (before | {letter}) for _, f in docs)
                sole = sum(f == {letter} for _, _, f in fails)
                good, toxic = (sum(labels.get(i, (0, 0))[c] == 1 for i in lost) for c in (0, 1))
                steps["".join(order), k + 1] = (kept, len(lost), len(fails) - len(lost), sole, good, toxic, letter)
        for (order, step), (*figures, letter) in steps.items():
            shapley = sum(s[1] for s in steps.values() if s[6] == letter)
            out.add((part, order, step, *figures, shapley))
    return out


def test_audit_matches_direct_counting(spark):
    varied = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", " \t", varied, varied, "same " * 300, "LOUD " * 10, "a # b", f"{varied} $", "é \U0001f600 ü", "x" * 300_000, varied.upper()]
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts * 3, ["web", None, "", "news", "web", "news", "web"] * 6))]
    labels = {i: (i % 2, int(i % 3 == 0)) for i in range(0, 36, 2)} | {999: (1, 1)}
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, source string, words string, shard int, ids string")
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()], "doc_id long, quality int, toxic int")
    found = {tuple(r) for r in filter_audit.audit(docs.repartition(5), marks).collect()}
    assert found == counted(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0


def test_matrix_holds_the_words_of_every_document(spark):
    texts = ["b a b c", "", "c d", "é b\tb\nb"] * 5
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    matrix = filter_audit.term_matrix(docs)
    words = {r.term_id: bytes(r.word).decode() for r in matrix.dictionary.select("term_id", F.col("word").cast("binary").alias("word")).collect()}
    assert sorted(words.values()) == ["a", "b", "c", "d", "é"]
    for shard in matrix.shards.collect():
        indptr, terms, counts = (np.frombuffer(shard[c], "<i8") for c in ("indptr", "terms", "counts"))
        for k, i in enumerate(shard.ids):
            row = slice(indptr[k], indptr[k + 1])
            want = {w: texts[i].split().count(w) for w in texts[i].split()}
            assert {words[t]: n for t, n in zip(terms[row], counts[row])} == want


def test_packing_keeps_integers():
    for values in ([], [5], [3, 70_000, 0, 2**31 - 1, 0, 1]):
        packed = filter_audit._packed(np.array(values, np.int64))
        assert filter_audit._unpacked(packed[0].as_py()).tolist() == values
