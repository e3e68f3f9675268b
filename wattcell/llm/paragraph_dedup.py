"""Passages that repeat across documents.

Two kinds of units are compared. Paragraphs (lines of ``MIN_WORDS`` words or more) get a MinHash
signature of their five-word shingles, cut into ``BANDS`` bands of four values: a pair with
similarity 0.8 misses all of them with probability 0.59^12, 2 in 1,000, and one at 0.3 with 0.9.
Colliding paragraphs are verified by exact Jaccard similarity and joined into
components. Passages inside paragraphs are found by windows of ``WINDOW`` words that begin where a shingle
hash is the smallest of ``GAP`` neighbours: any run of ``WINDOW + GAP - 1`` words (49) shared by two
documents holds a window that begins at the same word in both. Windows are only seeds: each is compared with the first place of
its words, and with the first in its own document, and grown word by word to the whole equal run.

Of each component the first unit by document and word stays; the others are to be removed. A passage that
loops within a document keeps its first ``WINDOW`` words at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattcell.llm.links import bucket_keys, linked_groups, overlapping, pair_nodes, ranges_for, shared_buckets, short, small_side
from wattcell.llm.minmax_dedup import bands, may_overlap, signature_samples
from wattcell.llm.text import hashed, lists, mix, multipliers, shingles, signed
from wattcell.session import materialize

GRAM = 5
PERCENT = 80
MIN_WORDS = 20
BANDS = 12
ROWS = 4
WINDOW = 20
GAP = 30
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_UNITS = "doc long, start int, n_words int, paragraph boolean, k1 long, k2 long, " + ", ".join(f"b{i} long" for i in range(BANDS))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the word sequences from ``starts`` to before ``ends``."""
    up, down = _powers(_BASE, len(h) + 1), _powers(_BACK, len(h) + 1)
    out = []
    for x in (h, mix(h)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:-1], dtype=np.uint64)])
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def _paragraph_bands(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of band hashes for each paragraph of at least GRAM words."""
    if not len(starts):
        return np.empty((0, BANDS), np.uint64)
    grams = shingles(h, GRAM)
    cuts = np.stack([starts, ends - GRAM + 1], axis=1).ravel()
    low = np.empty((len(starts), len(factors)), np.uint64)
    values = np.full(len(grams) + 1, np.iinfo(np.uint64).max, np.uint64)
    for i, (factor, offset) in enumerate(zip(factors, offsets, strict=True)):
        values[:-1] = grams * factor + offset
        low[:, i] = np.minimum.reduceat(values, cuts)[::2]
    return bands(low, ROWS)


def _anchors(h: np.ndarray) -> np.ndarray:
    """Where windows begin: the smallest shingle hash of every GAP neighbouring places."""
    last = len(h) - WINDOW + 1
    if last <= 0:
        return np.empty(0, np.int64)
    grams = shingles(h, GRAM)
    values = grams[:last]
    if last <= GAP:
        return np.array([int(values.argmin())])
    return np.unique(np.lib.stride_tricks.sliding_window_view(values, GAP).argmin(axis=1) + np.arange(last - GAP + 1))


def _thin_loops(begin: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which windows to keep: of equal windows that each overlap the one before, the first two tell the period."""
    order = np.lexsort((begin, names))
    follows = np.zeros(len(begin), bool)
    follows[1:] = (names[order[1:]] == names[order[:-1]]) & (np.diff(begin[order]) < WINDOW)
    keep = np.ones(len(begin), bool)
    keep[order[1:]] = ~(follows[1:] & follows[:-1])
    return keep


def _grown(h: np.ndarray, g: np.ndarray, at: np.ndarray, first: np.ndarray, same: bool) -> Iterator[tuple[int, int, int]]:
    """Start, words and first place of the equal runs of ``h`` and ``g`` around windows; ``same`` if both are one document."""
    for offset in np.unique(at - first):
        low, high = max(0, offset), min(len(h), len(g) + offset)
        breaks = np.flatnonzero(h[low:high] != g[low - offset : high - offset]) + low
        edges = np.concatenate([[low - 1], breaks, [high]])
        starts = at[(at - first == offset) & (at >= low)]
        k = np.searchsorted(edges, starts, side="right")
        for i in np.unique(k[(k < len(edges)) & (edges[np.minimum(k, len(edges) - 1)] - starts >= WINDOW)]):
            begin, end = int(edges[i - 1]) + 1, int(edges[i])
            place = begin - int(offset)
            begin = max(begin, place + WINDOW) if same else begin
            if begin < end:
                yield begin, end - begin, place


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Paragraphs and windows of all documents, by place (in words) and name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = multipliers(BANDS * ROWS, 3)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                banded: list[np.ndarray] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    lines = [line.split() for line in text.as_py().encode("utf-8", "surrogatepass").lower().split(b"\n")]
                    counts = np.array([len(x) for x in lines], np.int64)
                    if counts.sum() < MIN_WORDS:
                        continue
                    h = hashed([w for line in lines for w in line])
                    ends = np.cumsum(counts)
                    long = counts >= MIN_WORDS
                    starts, stops = (ends - counts)[long], ends[long]
                    begin = _anchors(h)
                    begin = begin[_thin_loops(begin, _runs(h, begin, begin + WINDOW)[0])]
                    all_starts, all_ends = np.concatenate([starts, begin]), np.concatenate([stops, begin + WINDOW])
                    k1, k2 = _runs(h, all_starts, all_ends)
                    columns[0].append(np.full(len(all_starts), doc, np.int64))
                    columns[1].append(all_starts.astype(np.int32))
                    columns[2].append((all_ends - all_starts).astype(np.int32))
                    columns[3].append(np.arange(len(all_starts)) < len(starts))
                    columns[4].append(signed(k1))
                    columns[5].append(signed(k2))
                    table = np.zeros((len(all_starts), BANDS), np.uint64)
                    table[: len(starts)] = _paragraph_bands(h, starts, stops, factors, offsets)
                    banded.append(table)
                if not banded:
                    continue
                flat = [np.concatenate(c) for c in columns]
                table, window = signed(np.concatenate(banded)), ~flat[3]
                arrays = [pa.array(c) for c in flat] + [pa.array(table[:, i], pa.int64(), mask=window) for i in range(BANDS)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _UNITS.split(", ")])

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, _UNITS)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``bucket_keys`` makes of ``k1, b0, ..``: every band is a bucket of its own."""
    for batch in batches:
        nodes, *found = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1 + BANDS))
        yield np.concatenate(found), np.tile(nodes, BANDS), np.ones(len(nodes) * BANDS, bool)


def _paragraph_sets(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, grams`` of the paragraphs at ``places`` (node, doc, start, n_words)."""
    wanted = places.groupBy("doc").agg(F.collect_list(F.struct("node", "start", "n_words")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                nodes, grams = [], []
                for text, places_ in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    h = hashed(text.as_py().encode("utf-8", "surrogatepass").lower().split())
                    for p in places_:
                        nodes.append(p["node"])
                        grams.append(signed(np.unique(shingles(h[p["start"] : p["start"] + p["n_words"]], GRAM))))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists(grams, pa.int64())], names=["node", "grams"])

    found = texts.join(wanted, "doc").select("text", "wanted")
    return found.mapInArrow(scan, "node long, grams array<long>").dropDuplicates(["node"])


def _whole_runs(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, start, n_words, first_doc, first_start``: the whole equal runs around windows (``doc, start, first_doc, first_start``)."""
    wanted = seeds.groupBy("doc", "first_doc").agg(F.collect_set(F.struct("start", "first_start")).alias("at"))
    wanted = materialize(wanted, "seeds")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    firsts = texts.select(F.col("doc").alias("first_doc"), F.col("text").alias("first_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for row in batch.slice(i, 64).to_pylist():
                    h, g = (hashed(row[c].encode("utf-8", "surrogatepass").lower().split()) for c in ("text", "first_text"))
                    at, first = (np.array([p[c] for p in row["at"]], np.int64) for c in ("start", "first_start"))
                    doc, first_doc = row["doc"], row["first_doc"]
                    out += [(doc, start, n, first_doc, place) for start, n, place in _grown(h, g, at, first, doc == first_doc)]
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                    columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc", "start", "n_words", "first_doc", "first_start"])

    found = wanted.join(texts, "doc").join(firsts, "first_doc").where("text IS NOT NULL AND first_text IS NOT NULL")
    found = found.select("doc", "text", "first_doc", "first_text", "at")
    return found.mapInArrow(scan, "doc long, start int, n_words int, first_doc long, first_start int")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc, start, n_words, first_doc, first_start`` of every paragraph and run of words that repeats an earlier one."""
    found = materialize(units(docs, id_col, text_col), "units")
    names = [f"b{i}" for i in range(BANDS)]
    paragraphs = found.where("paragraph")
    # Copies need no class of their own here: their bands repeat the same bucket and node.
    keys = bucket_keys(paragraphs.select("k1", *names), _band_keys, ranges_for(paragraphs.count() * BANDS))
    shared = materialize(shared_buckets(keys), "shared")
    nodes = paragraphs.select(F.col("k1").alias("node")).distinct().withColumn("short", short(F.col("node")))
    buckets = materialize(shared.join(nodes, "short").select("bucket", "node"), "buckets")

    def sets_of(nodes: DataFrame) -> DataFrame:
        places = paragraphs.select(F.col("k1").alias("node"), "doc", "start", "n_words").join(nodes, "node", "left_semi")
        at = F.min(F.struct("doc", "start", "n_words")).alias("at")
        return _paragraph_sets(docs, places.groupBy("node").agg(at).select("node", "at.*"), id_col, text_col)

    def verify(pairs: DataFrame) -> DataFrame:
        return overlapping(pairs, materialize(sets_of(pair_nodes(pairs)), "sets"), percent)

    groups = linked_groups(
        buckets, verify, lambda nodes: signature_samples(sets_of(small_side(nodes))), lambda x, y: may_overlap(x, y, percent)
    )
    classes = paragraphs.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    linked = classes.join(groups.withColumnRenamed("node", "k1"), "k1", "left").where("n > 1 OR component IS NOT NULL")
    linked = linked.select("k1", "k2", F.lit(True).alias("paragraph"), F.coalesce("component", "k1").alias("group"))
    windows = found.where("NOT paragraph").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    windows = windows.select("k1", "k2", F.lit(False).alias("paragraph"), F.col("k1").alias("group"))
    linked = materialize(linked.unionByName(windows), "groups")
    thin = found.select("doc", "start", "n_words", "paragraph", "k1", "k2")
    places = materialize(thin.join(small_side(linked), ["k1", "k2", "paragraph"]).drop("k1", "k2"), "places")
    first = places.groupBy("paragraph", "group").agg(F.min(F.struct("doc", "start")).alias("first"))
    first = materialize(first.select("paragraph", "group", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start")), "first")
    gone = places.join(small_side(first), ["paragraph", "group"]).where("doc <> first_doc OR start <> first_start")
    gone = gone.select("doc", "start", "n_words", "first_doc", "first_start", "paragraph")
    # Windows that a document holds more than once are also seeds of runs within it.
    own = places.where("NOT paragraph").groupBy("doc", "group").agg(F.min("start").alias("own"), F.max("start").alias("last"))
    own = places.where("NOT paragraph").join(own.where("own < last"), ["doc", "group"]).where("start > own")
    seeds = gone.where("NOT paragraph").select("doc", "start", "first_doc", "first_start")
    seeds = seeds.unionByName(own.select("doc", "start", F.col("doc").alias("first_doc"), F.col("own").alias("first_start")))
    return gone.where("paragraph").drop("paragraph").unionByName(_whole_runs(docs, seeds, id_col, text_col))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``id, start, n_words, first_id``: stretches of words to remove from documents, none overlapping.

    Places count words from 0; ``first_id`` is the smallest document that holds what is removed. Null,
    empty and short texts have no passage, rows with a null id are left out. Repeated rows of one id
    count as one document: only their second places are removed, never the first.
    """
    gone = repeated_units(docs, id_col, text_col, percent).distinct()
    order = W.partitionBy("doc").orderBy("start", "n_words")
    reach = F.max(F.col("start") + F.col("n_words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = gone.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    opened = opened.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = opened.groupBy("doc", "span").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n_words")).alias("end"), F.min("first_doc").alias("first")
    )
    return spans.select(
        F.col("doc").alias(id_col), F.col("start").cast("long").alias("start"),
        (F.col("end") - F.col("start")).cast("long").alias("n_words"), F.col("first").alias(f"first_{id_col}"),
    )
