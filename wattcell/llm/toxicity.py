"""Toxicity by class-conditional Kneser-Ney models.

There are two models of each kind, one of toxic and one of ordinary documents, that share their
backoff: P(w | context, class) = max(n - D, 0) / N + D * T / N * S(w), where n, N and T are the
class's count, total and number of kinds, and S comes from both classes together. What a class has
not seen falls back on the shared counts, so rare expressions weigh little either way.

One kind reads runs of five symbols (letters, digits, gaps, and four for other bytes), with
the continuation distribution of the shorter context as S. The other reads words, with their shared
frequency as S. Runs number 2^25 at most and words are hashed to 2^25 cells, which bounds
the models however large the corpus is; the counts are those of all labelled documents.

A text's evidence is its log-likelihood ratio, normalised by length: per symbol over its most toxic
``STRETCH`` symbols, per word over its ``TOP`` most toxic words, and of the most toxic word, so that a few words in a
long text still show, and per symbol and per word over the whole text, so that many mild expressions show as well. A logistic curve turns them into a probability. It is fitted on a quarter of the labelled documents
(a bounded sample of ``CALIBRATION`` rows of it) with a model that counts the others; the final model counts all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.llm.links import small_side
from wattcell.llm.text import hashed
from wattcell.session import materialize

DISCOUNT = 0.75
STRETCH = 10
TOP = 3
CALIBRATION = 20_000
RIDGE = 0.1
EVIDENCE = ("stretch", "words", "word", "all_symbols", "all_words")
PIECE = 1 << 20
_BITS, _ORDER = 5, 5
_CELLS = 1 << (_BITS * _ORDER)
_CONTEXTS = _CELLS >> _BITS


def _symbols() -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[ord("0") : ord("9") + 1] = 27
    table[128:] = 28 + (np.arange(128, 256) & 3)
    return table


_TABLE = _symbols()
#: Bytes of words: a to z and what belongs to other alphabets in UTF-8.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def runs(text: str | None) -> Iterator[np.ndarray]:
    """Numbers of the five-symbol runs of a text, in pieces; neighbouring pieces share STRETCH - 1 runs."""
    symbols = _TABLE[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols = symbols[keep]
    if not symbols.any():
        return
    symbols = np.concatenate([np.zeros(_ORDER - 1, np.uint32), symbols, np.zeros(1, np.uint32)])
    last = len(symbols) - _ORDER + 1
    for start in range(0, last, PIECE):
        part = symbols[start : min(start + PIECE + STRETCH - 1, last) + _ORDER - 1]
        out = np.zeros(len(part) - _ORDER + 1, np.uint32)
        for i in range(_ORDER):
            out = (out << _BITS) | part[i : len(part) - _ORDER + 1 + i]
        yield out


def word_cells(text: str | None) -> np.ndarray:
    """Cells of the words (runs of letters, a to z in lower case) of a text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS).split()
    return (hashed(tokens) & np.uint64(_CELLS - 1)).astype(np.int64)


@dataclass
class Model:
    """Log-likelihood ratios of the seen runs, of what else follows their contexts, and of words; logistic weights."""

    runs: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    other_words: float
    rate: float
    weights: np.ndarray | None = None


def dense_tables(runs_: tuple, contexts: tuple, words: tuple, other_words: float) -> tuple[np.ndarray, np.ndarray]:
    """The ratio of every possible run (its own, else that of its context, else 0) and of every word cell."""
    dense = np.zeros((_CONTEXTS, 1 << _BITS), np.float16)
    dense[contexts[0]] = contexts[1][:, None]
    dense = dense.ravel()
    dense[runs_[0]] = runs_[1]
    of_words = np.full(_CELLS, other_words, np.float16)
    of_words[words[0]] = words[1]
    return dense, of_words


def evidence(tables: tuple[np.ndarray, np.ndarray], text: str | None) -> tuple[float, ...]:
    """Ratio per symbol of the most toxic stretch, mean of the most toxic words, the highest, and the means of all
    symbols and words; 0 for a text without any."""
    stretch, total, n = -np.inf, 0.0, 0
    for part in runs(text):
        sums = np.concatenate([[0.0], np.cumsum(tables[0][part], dtype=np.float64)])
        wide, own = min(STRETCH, len(part)), min(PIECE, len(part))
        stretch = max(stretch, (sums[wide:] - sums[:-wide]).max() / wide)
        total, n = total + sums[own], n + own
    ratios = tables[1][word_cells(text)].astype(np.float64)
    if not len(ratios):
        return (stretch, 0.0, 0.0, total / n, 0.0) if n else (0.0,) * len(EVIDENCE)
    top = np.partition(ratios, -TOP)[-TOP:] if len(ratios) > TOP else ratios
    return (stretch, top.mean(), top.max(), total / n, ratios.mean()) if n else (0.0, top.mean(), top.max(), 0.0, ratios.mean())


class _Tally:
    """Counts of numbers whose lowest bit is the class, merged as they grow."""

    def __init__(self):
        self.cells, self.counts = np.empty(0, np.int64), np.empty((0, 2), np.int64)
        self.waiting, self.held = [], 0

    def add(self, cells: np.ndarray, toxic: int) -> None:
        self.waiting.append((cells.astype(np.int64) << 1) | toxic)
        self.held += len(cells)
        if self.held > 2_000_000:
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        seen, times = np.unique(np.concatenate(self.waiting), return_counts=True)
        keys, place = np.unique(np.concatenate([self.cells, seen >> 1]), return_inverse=True)
        merged = np.zeros((len(keys), 2), np.int64)
        merged[place[: len(self.cells)]] += self.counts
        np.add.at(merged, (place[len(self.cells) :], seen & 1), times)
        self.cells, self.counts, self.waiting, self.held = keys, merged, [], 0


def _count(texts: DataFrame) -> DataFrame:
    """``word, cell, n0, n1``: how often each run and each word stands in ordinary and toxic texts (``text, toxic``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tally(), _Tally()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for part in runs(text.as_py()):
                    tallies[0].add(part[:PIECE], toxic)
                tallies[1].add(word_cells(text.as_py()), toxic)
        for word, tally in enumerate(tallies):
            tally.fold()
            for i in range(0, len(tally.cells), 100_000):
                part = slice(i, i + 100_000)
                columns = [pa.array(x, pa.int64()) for x in (tally.cells[part], tally.counts[part, 0], tally.counts[part, 1])]
                yield pa.RecordBatch.from_arrays([pa.array([bool(word)] * len(columns[0])), *columns], names=["word", "cell", "n0", "n1"])

    found = texts.select("text", "toxic").mapInArrow(scan, "word boolean, cell long, n0 long, n1 long")
    return found.groupBy("word", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _word_ratios(counts: DataFrame) -> tuple[DataFrame, float]:
    """Log-likelihood ratios of words (``cell, ratio``) and that of words not seen."""
    sums = counts.agg(*[F.sum(f"n{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0) for c in (0, 1)]).first()
    total, kinds = [max(x, 1) for x in sums[:2]], [max(x, 1) for x in sums[2:]]
    back = (F.col("n0") + F.col("n1")) / F.lit(float(sum(total)))
    parts = [(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) + back * (DISCOUNT * kinds[c])) / total[c] for c in (0, 1)]
    other = math.log(kinds[1] / total[1]) - math.log(kinds[0] / total[0])
    return counts.select("cell", F.log(parts[1] / parts[0]).alias("ratio")), other


def _ratios(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log-likelihood ratios (``cell, ratio``) and defaults (``context, ratio``) from all counts."""
    context = F.shiftright("cell", _BITS)
    shorter = F.col("cell").bitwiseAND(F.lit(_CONTEXTS - 1))
    totals = counts.groupBy(context.alias("context")).agg(
        *[F.sum(f"n{c}").alias(f"total{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"types{c}") for c in (0, 1)]
    )
    loose = [F.when(F.col(f"total{c}") > 0, F.lit(DISCOUNT) * F.col(f"types{c}") / F.col(f"total{c}")).otherwise(1.0) for c in (0, 1)]
    totals = totals.withColumn("loose0", loose[0]).withColumn("loose1", loose[1])
    low = counts.groupBy(shorter.alias("shorter")).agg(F.count("*").alias("left"))
    low_totals = low.groupBy(F.shiftright("shorter", _BITS).alias("before")).agg(F.sum("left").alias("lefts"), F.count("*").alias("kinds"))
    low = low.join(low_totals, F.shiftright("shorter", _BITS) == F.col("before"))
    back = (F.col("left") - DISCOUNT) / F.col("lefts") + F.lit(DISCOUNT) * F.col("kinds") / F.col("lefts") / (1 << _BITS)
    low = low.select("shorter", back.alias("back"))
    joined = counts.withColumn("context", context).withColumn("shorter", shorter).join(totals, "context").join(low, "shorter")

    def likelihood(c: int) -> Column:
        own = F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"total{c}")).otherwise(0.0)
        return own + F.col(f"loose{c}") * F.col("back")

    cells = joined.select("cell", F.log(likelihood(1) / likelihood(0)).alias("ratio"))
    return cells, totals.select("context", F.log(F.col("loose1") / F.col("loose0")).alias("ratio"))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of y on the standardised columns of x, by Newton steps: weights for raw columns."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.diag([0.0] + [RIDGE] * x.shape[1])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ b)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = b[1:] / scale
    return np.concatenate([[b[0] - slope @ mean], slope])


def _columns(table: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    arrow = table.select(*names).toArrow()
    return tuple(arrow.column(n).to_numpy() for n in names)


def _model(counts: DataFrame, rate: float) -> Model:
    """The ratios of all counts, without weights; no ratios where a class has no run."""
    nothing = (np.empty(0, np.int64), np.empty(0))
    model = Model(nothing, nothing, nothing, 0.0, rate)
    sums = counts.where("NOT word").agg(F.sum("n0"), F.sum("n1")).first()
    if not sums[0] or not sums[1]:
        return model
    cells, defaults = _ratios(counts.where("NOT word"))  # at most 2^25 and 2^20 rows
    model.runs, model.contexts = _columns(cells, "cell", "ratio"), _columns(defaults, "context", "ratio")
    words, model.other_words = _word_ratios(counts.where("word"))  # at most 2^25 rows
    model.words = _columns(words, "cell", "ratio")
    return model


def learn(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the labelled documents for which ``training`` holds.

    Labels other than 0 and 1, null ids and null texts teach nothing; an id labelled both ways is toxic.
    A quarter of the documents, by a hash of the id, is held back while the logistic curve is fitted, then counted too.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = materialize(marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic")), "labels")
    texts = docs.where(training & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(small_side(marks), "id")
    held = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)) == 0
    counts = materialize(_count(texts.where(~held)), "counts")
    rate = marks.agg(F.avg("toxic")).first()[0] or 0.0
    weights = None
    model = _model(counts, rate)
    if len(model.runs[0]):
        seen = _evidence(texts.where(held), model, "toxic")
        sample = seen.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION)
        *columns, toxic = _columns(sample, *EVIDENCE, "toxic")
        if 0 < toxic.sum() < len(toxic):
            weights = _logistic(np.column_stack(columns), toxic)
    del model
    both = counts.unionByName(_count(texts.where(held))).groupBy("word", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = _model(materialize(both, "counts"), rate)
    model.weights = weights
    return model


def _evidence(texts: DataFrame, model: Model, *more: str) -> DataFrame:
    """``id``, the columns ``more`` and the evidence of ``id, text``."""
    parts = (model.runs, model.contexts, model.words, model.other_words)  # at most 2^25 cells each
    shared = texts.sparkSession.sparkContext.broadcast(parts)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = dense_tables(*shared.value)
        for batch in batches:
            found = [evidence(tables, text.as_py()) for text in batch.column("text")]
            rest = batch.drop_columns(["text"])
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(EVIDENCE))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *EVIDENCE])

    texts = texts.select("id", *more, "text")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields if f.name != "text"]
    return texts.mapInArrow(scan, ", ".join([*kinds, *[f"{name} double" for name in EVIDENCE]]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row: the probability of label 1.

    Null, empty and symbol-free texts have no evidence and score as such. Where the labels did not
    hold both classes every score is the share of toxic labels. Repeated rows and null ids are returned
    as they come.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model.weights is None:
        return texts.select(F.col("id").alias(id_col), F.lit(float(model.rate)).alias("score"))
    at = F.lit(float(model.weights[0]))
    for name, weight in zip(EVIDENCE, model.weights[1:], strict=True):
        at = at + F.lit(float(weight)) * F.col(name)
    return _evidence(texts, model).select(F.col("id").alias(id_col), (F.lit(1.0) / (F.lit(1.0) + F.exp(-at))).alias("score"))
