"""Near-duplicate documents by min-max hashing.

Under each of ``PERMUTATIONS`` hash permutations a document keeps the smallest and the largest
value of its shingles, which gives two signature values for one evaluation. Bands of
``ROWS`` values (two permutations) are the buckets. With 20 bands of 4 values a pair with
similarity 0.8 misses every bucket with probability 0.59^20, about 3 in 100,000; a pair at
0.02, as of unrelated texts, shares one with probability 3 in a million. Links are confirmed on
the full shingle sets. Before that, pairs across groups must agree in 75.5 of 100 four-bit samples of a
signature of 1024 values, made for the members of mixed buckets only: 81 are expected at similarity 0.8, with a
deviation below 1.8, and 72 at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.llm.links import fresh, linked_groups, overlapping, pair_nodes, small_side
from wattcell.llm.text import hashed, lists, mix, multipliers, shingles, signed, words
from wattcell.session import materialize

PERMUTATIONS = 40
ROWS = 4
CHUNK = 8192
SAMPLES = 1024
LEAST_AGREEING = 0.755
ROUGH_MARGIN = 0.055


def signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Smallest and largest value under every permutation, side by side."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for i in range(0, len(grams), CHUNK):
        values = grams[i : i + CHUNK, None] * factors + offsets
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A bucket for every run of ``rows`` values in the last axis; equal runs at other places differ."""
    table = values.reshape(*values.shape[:-1], -1, rows)
    places = np.arange(1, table.shape[-2] + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = np.broadcast_to(places, table.shape[:-1])
    for i in range(rows):
        out = mix(out ^ table[..., i])
    return out


def signature_samples(sets: DataFrame) -> DataFrame:
    """``node, size, lane0, ..`` of ``node, grams``: four bits of SAMPLES signature values, sixteen to a number."""
    names = [f"lane{i}" for i in range(SAMPLES // 16)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = multipliers(SAMPLES // 2, 99)
        for batch in batches:
            sizes, rows = [], [np.zeros((0, len(names)), np.uint64)]
            for grams in batch.column("grams"):
                values = np.asarray(grams.values, np.int64).view(np.uint64)
                bits = (mix(signature(values, factors, offsets)) >> np.uint64(60)).reshape(-1, 16)
                rows.append((bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)[None])
                sizes.append(len(values))
            table = signed(np.concatenate(rows))
            columns = [pa.array(table[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), *columns], names=["node", "size", *names])

    return sets.mapInArrow(scan, "node long, size long, " + ", ".join(f"{n} long" for n in names))


def may_overlap(x: str, y: str, percent: int) -> Column:
    """Whether sizes and signature samples under two aliases allow that much overlap."""
    small, large = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    differ, rough = F.lit(0), F.lit(True)
    for i in range(SAMPLES // 16):
        if i == SAMPLES // 64:  # most pairs fail on a quarter of the samples already
            rough = differ <= int(SAMPLES / 4 * (1 - LEAST_AGREEING + ROUGH_MARGIN))
        t = F.col(f"{x}.lane{i}").bitwiseXOR(F.col(f"{y}.lane{i}"))
        t = t.bitwiseOR(F.shiftrightunsigned(t, 1))
        t = t.bitwiseOR(F.shiftrightunsigned(t, 2))
        differ = differ + F.bit_count(t.bitwiseAND(F.lit(0x1111111111111111)))
    return (F.lit(100) * small >= F.lit(percent) * large) & rough & (differ <= int(SAMPLES * (1 - LEAST_AGREEING)))


def _set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles; grams are distinct and sorted."""
    a, b = mix(grams ^ np.uint64(0x5851F42D4C957F2D)), mix(grams + np.uint64(0x14057B7EF767814F))
    return int(signed(a.sum(keepdims=True))[0]), int(signed(b.sum(keepdims=True))[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, gram: int, permutations: int, rows: int) -> DataFrame:
    """``id, n_shingles, k1, k2, bands`` of every row; no bands where there is no word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = multipliers(permutations, 9)
        for batch in batches:
            sizes, keys, parts = [], [], []
            for text in batch.column(1):
                grams = np.unique(shingles(hashed(words(text.as_py())), gram))
                sizes.append(len(grams))
                keys.append(_set_key(grams) if len(grams) else (0, 0))
                parts.append(signed(bands(signature(grams, factors, offsets), rows)) if len(grams) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    lists(parts, pa.int64()),
                ],
                names=["id", "n_shingles", "k1", "k2", "bands"],
            )

    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(scan, "id long, n_shingles long, k1 long, k2 long, bands array<long>")


def shingle_sets(texts: DataFrame, gram: int) -> DataFrame:
    """``node, grams``: the distinct shingle hashes of ``node, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                grams = [signed(np.unique(shingles(hashed(words(t.as_py())), gram))) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists(grams, pa.int64())], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(scan, "node long, grams array<long>")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row.

    Documents with the same shingle set count as one class; classes are linked when
    100 * intersection >= percent * union of their sets, and ``component_id`` is the smallest id
    of the linked classes. Null, empty and blank texts have no shingle and link with nothing. A
    row with a null id is its own group (``component_id`` null, kept). Repeated rows are returned
    as often as they come, each with the same component. Other columns of ``docs`` play no part.
    """
    marks = materialize(signatures(docs, id_col, text_col, gram, permutations, rows), "signatures")
    named = marks.where("n_shingles > 0 AND id IS NOT NULL")
    classes = named.groupBy("k1", "k2").agg(
        F.min("id").alias("node"), F.min("bands").alias("bands")
    )
    classes = materialize(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), "node")

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
        return shingle_sets(texts.join(nodes, "node", "left_semi"), gram).dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        return overlapping(pairs, materialize(sets_of(pair_nodes(pairs)), "sets"), percent)

    groups = linked_groups(
        buckets, verify, lambda nodes: signature_samples(sets_of(small_side(nodes))), lambda x, y: may_overlap(x, y, percent)
    )
    named_classes = classes.select("k1", "k2", "node").join(groups, "node", "left")
    found = named_classes.select("k1", "k2", F.coalesce("component", "node").alias("class"))
    out = marks.select("id", "n_shingles", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the first of their group; columns as given.

    Repeated rows of a kept id all stay; a row with a null id stays.
    """
    id_col = options.get("id_col", "doc_id")
    found = near_duplicates(docs, **options)
    name = fresh(docs, "_gone")
    gone = found.where("NOT kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
