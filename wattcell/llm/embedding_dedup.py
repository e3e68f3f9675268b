"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are scaled to length 1 and projected on many random directions. Two vectors at distance c
differ by a normal with deviation c in each projection, so close ones fall into each other's window far
more often than others do. A pair is verified by its exact cosine when it collides in at least
``least`` of ``COUNTED`` projections; the window and the count are set so that a pair at the threshold falls
short once in 10,000 times.

Windows alone would pair a quarter of all vectors by chance. So the search is sorted by cells:
in each of ``tables`` rounds the cells of ``depth`` further projections are one key, and windows are counted
among vectors with the same key. ``depth`` grows with the logarithm of the number of vectors, to
keep about ``CHANCE`` unrelated ones in a cell, and ``tables`` is what a recall of 0.999 at the threshold needs.
Crowded cells are dealt out in blocks of ``BLOCK`` vectors, each pair of blocks a task of its own, and a
pair counts only in the first table in which it shares a cell: nothing is dropped and no pair is stored.
Equal vectors are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattcell.llm.links import components
from wattcell.session import materialize

COSINE = 0.9
RECALL = 0.999
CHANCE = 512
COUNTED = 24
BLOCK = 1024
CELL = 3.36  # cell width, in distances at the threshold
WINDOW = 1.34  # half window, in distances at the threshold


@dataclass(frozen=True)
class Plan:
    """Sizes of the search for ``n`` vectors."""

    cosine: float
    depth: int
    tables: int
    least: int
    distance: float


def _same_cell(width: float) -> float:
    """Chance that two points a unit normal apart share a random cell of that width."""
    return math.erf(width / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-(width**2) / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
    """Calibrated for pairs at the threshold; unrelated vectors are taken to be a right angle apart."""
    distance = math.sqrt(2 - 2 * cosine)
    near, far = _same_cell(CELL), _same_cell(CELL * distance / math.sqrt(2))
    depth = max(1, math.ceil(math.log(max(n, 1) / CHANCE) / -math.log(far))) if n > CHANCE else 1
    tables = math.ceil(math.log(1 - recall) / math.log(1 - near**depth))
    hit = math.erf(WINDOW / math.sqrt(2))
    least = math.floor(COUNTED * hit - 3.9 * math.sqrt(COUNTED * hit * (1 - hit)))
    return Plan(cosine, depth, tables, least, distance)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _cells(unit: np.ndarray, p: Plan) -> np.ndarray:
    """A 32-bit cell number for each vector and table."""
    draw = np.random.default_rng([8, unit.shape[1]])
    directions = draw.standard_normal((unit.shape[1], p.tables * p.depth))
    width = CELL * p.distance
    places = np.floor(unit @ directions / width + draw.random(p.tables * p.depth)).astype(np.int64)
    out = np.full((len(unit), p.tables), unit.shape[1], np.uint64)
    for i in range(p.depth):
        out = (out ^ places[:, i :: p.depth].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _placed(classes: DataFrame, p: Plan) -> DataFrame:
    """``node, n, vector, cells`` of every class of vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("vector")])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                cells = _cells(_unit(_matrix(part.column("vector"))), p)
                column = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel(), pa.int32()), p.tables).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("node", "n", "vector")] + [column], names=["node", "n", "vector", "cells"])

    return classes.select("node", "n", "vector").mapInArrow(scan, "node long, n long, vector array<double>, cells array<int>")


def _compare(rows: dict[str, np.ndarray], p: Plan) -> Iterator[np.ndarray]:
    """(node, links, smallest linked node) of the classes in one pair of blocks of one cell."""
    first, second = np.flatnonzero(rows["side"] != 1), np.flatnonzero(rows["side"] != 0)
    inside = bool((rows["side"] == 2).all())
    unit = _unit(rows["vector"])
    table = int(rows["table"][0])
    draw = np.random.default_rng([80, unit.shape[1]])
    spots = unit @ draw.standard_normal((unit.shape[1], COUNTED))
    count = np.zeros((len(first), len(second)), np.uint8)
    for j in range(COUNTED):
        # The window of each query is a range of the sorted projection.
        count += np.abs(spots[first, j, None] - spots[None, second, j]) <= WINDOW * p.distance
    a, b = np.nonzero(count >= p.least)
    if inside:
        a, b = a[a < b], b[a < b]
    a, b = first[a], second[b]
    linked = np.concatenate([np.einsum("ij,ij->i", unit[a[i : i + 20_000]], unit[b[i : i + 20_000]]) >= p.cosine for i in range(0, len(a), 20_000)] or [np.empty(0, bool)])
    a, b = a[linked], b[linked]
    if table:
        earlier = np.concatenate([(rows["cells"][a[i : i + 20_000], :table] == rows["cells"][b[i : i + 20_000], :table]).any(axis=1) for i in range(0, len(a), 20_000)] or [np.empty(0, bool)])
        a, b = a[~earlier], b[~earlier]
    if not len(a):
        return
    node, n = rows["node"], rows["n"]
    links, low = np.zeros(len(node), np.int64), node.copy()
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    while True:  # smallest node reachable within the cell
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            break
    some = links > 0
    yield np.stack([node[some], links[some], low[some]], axis=1)


def _links(dealt: DataFrame, p: Plan) -> DataFrame:
    """``node, links, low`` from rows sorted by (table, cell, x, y), each pair of blocks after the other."""
    names = ["table", "cell", "x", "y", "side", "node", "n", "vector", "cells"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(block: pa.Table) -> Iterator[pa.RecordBatch]:
            if block.num_rows < 2:
                return
            rows = {c: block.column(c).to_numpy() for c in ("table", "side", "node", "n")}
            rows["vector"] = _matrix(block.column("vector"))
            rows["cells"] = np.array(block.column("cells").to_pylist(), np.int32)
            for out in _compare(rows, p):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(3)], names=["node", "links", "low"])

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            keys = np.stack([held.column(c).to_numpy() for c in ("table", "cell", "x", "y")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            start = 0
            for cut in cuts:
                yield from solve(held.slice(start, cut - start))
                start = cut
            held = held.slice(start)
        if held is not None:
            yield from solve(held)

    return dealt.select(*names).mapInArrow(scan, "node long, links long, low long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """``id, n_links, component_id, kept`` of every row.

    Two vectors link when their cosine in double precision is at least ``cosine``. Null, empty and zero
    vectors, and those with a null or non-finite component, link with nothing, nor do vectors of
    different lengths. Equal vectors, repeated rows included, count one by one in ``n_links``. A row with a
    null id links with nothing, its ``component_id`` is null and it is kept.
    """
    thin = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    sound = sound & F.exists("vector", lambda x: x != 0.0) & F.col("id").isNotNull()
    named = thin.where(F.coalesce(sound, F.lit(False)))
    plus = F.transform("vector", lambda x: x + F.lit(0.0))  # -0.0 counts as 0.0
    named = named.select("id", plus.alias("vector")).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(8), "vector"))
    classes = named.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = materialize(classes, "classes")
    p = plan(classes.count(), cosine, recall)
    placed = materialize(_placed(classes, p), "placed")

    rows = placed.select("node", F.posexplode("cells").alias("table", "cell"))
    crowd = rows.groupBy("table", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("size"))
    rows = placed.select("node", "n", "vector", "cells", F.posexplode("cells").alias("table", "cell"))
    rows = rows.join(crowd.where("size > 1"), ["table", "cell"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    rows = rows.select("table", "cell", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), side.alias("side"), "node", "n", "vector", "cells")
    dealt = rows.repartition("table", "cell", "x", "y").sortWithinPartitions("table", "cell", "x", "y")
    found = materialize(_links(dealt, p), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())

    out = classes.join(links, "node", "left").join(groups, "node", "left")
    out = out.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    good = named.select("id", "h1", "h2").join(out, ["h1", "h2"]).select("id", "n_links", "component_id")
    bad = thin.where(~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(bad).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("id", id_col)
