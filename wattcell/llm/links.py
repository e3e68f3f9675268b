"""Linked groups from hash buckets, without emitting all pairs of a group.

Candidates are rows that share a bucket. Every bucket first compares its members with its
smallest one and with its hub, the member whose buckets are the fullest; members that this
joins into one group need no further pair. Only in buckets that still hold several groups the pairs
across groups are compared, so every candidate pair is either compared or already joined through others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattcell.llm.text import lists, signed
from wattcell.session import materialize

Verify = Callable[[DataFrame], DataFrame]
#: Buckets (64 well mixed bits), nodes, whether the node owns the bucket and, where nodes have one, their level.
Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]]
BROADCAST_ROWS = 500_000
CELL_BITS = 31
#: Of these bits as many are the level of the node, if nodes have levels.
LEVEL_BITS = 6
BLOCK_KEYS = 1 << 20
RANGE_KEYS = 1 << 19


def small_side(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few fixed-size columns, marked for broadcast where its counted rows allow it.

    Beyond ``rows`` it stays unmarked and the join shuffles both sides; results are the same.
    """
    return F.broadcast(stored) if stored.count() <= rows else stored


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def short(node: Column) -> Column:
    """The 32 bits of a node that ``bucket_keys`` keeps."""
    return node.bitwiseAND(F.lit(0xFFFFFFFF))


def ranges_for(keys: int) -> int:
    """Into how many ranges to deal so many bucket keys."""
    return max(16, -(-keys // RANGE_KEYS))


def bucket_keys(rows: DataFrame, keys: Keys, ranges: int) -> DataFrame:
    """``part, keys``: the bucket members that ``keys`` makes of ``rows``, eight bytes each, by range of buckets.

    A key holds 31 bits of the bucket, which its range adds to, 32 bits of the node and whether the node owns the
    bucket. Buckets or nodes that fall together only add candidates, apart from two nodes alike in these 32 bits that
    share buckets with no third one. Levels take the place of the last bits of the bucket.
    """

    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, node, owner, *level = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket, node = bucket.view(np.uint64), node.view(np.uint64)
        part = ((bucket >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cell = bucket & np.uint64((1 << CELL_BITS) - 1)
        for at in level:
            cell = cell >> np.uint64(LEVEL_BITS) << np.uint64(LEVEL_BITS) | np.clip(at, 0, (1 << LEVEL_BITS) - 1).astype(np.uint64)
        packed = cell << np.uint64(33) | (node & np.uint64(0xFFFFFFFF)) << np.uint64(1) | (~owner).astype(np.uint64)
        order = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[order], return_index=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(parts), lists(np.split(signed(packed[order]), starts[1:]), pa.int64())], names=["part", "keys"]
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for found in keys(batches):
            held.append(found)
            count += len(found[0])
            if count >= BLOCK_KEYS:
                yield pack(held)
                held, count = [], 0
        if count:
            yield pack(held)

    return rows.mapInArrow(scan, "part int, keys array<long>")


def shared_buckets(keys: DataFrame, near: int | None = None) -> DataFrame:
    """``bucket, short, owner``: the members of all buckets with an owner and another node, from ``bucket_keys``.

    With ``near`` the nodes have levels, and a bucket is divided where the levels of its members, in their order,
    are further apart than that.
    """
    bits = 0 if near is None else LEVEL_BITS

    def find(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        packed = np.concatenate([c.flatten().to_numpy() for c in table.column("keys").chunks]).view(np.uint64)
        packed = np.unique(packed)
        # Of one node in one bucket the first says whether it owns it.
        packed = packed[np.diff(packed >> np.uint64(1), prepend=np.uint64(2**64 - 1)) != 0]
        cell, owner = packed >> np.uint64(33 + bits), packed & np.uint64(1) == 0
        level = (packed >> np.uint64(33) & np.uint64((1 << bits) - 1)).astype(np.int64)
        begins = np.diff(cell, prepend=np.uint64(2**64 - 1)) != 0
        begins |= np.diff(level, prepend=0) > (near or 0)
        starts = np.flatnonzero(begins)
        counts = np.diff(starts, append=len(packed))
        keep = np.repeat((counts > 1) & (np.add.reduceat(owner.astype(np.int64), starts) > 0), counts)
        bucket = np.cumsum(begins)[keep] | np.int64(part << CELL_BITS)
        node = signed(packed[keep] >> np.uint64(1) & np.uint64(0xFFFFFFFF))
        return pa.table({"bucket": bucket, "short": node, "owner": owner[keep]})

    return keys.groupBy("part").applyInArrow(find, "bucket long, short long, owner boolean")


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with an edge ``a, b``.

    Alternates between linking larger neighbours and smaller neighbours of each node to the
    smallest one until nothing changes: a logarithmic number of joins in practice. Each round
    is written to the shared folder, so that plans stay short and lost executors cost a re-read.
    Null ends and loops are ignored; no edges give no rows.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = materialize(small.distinct(), "small")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def across_groups(members: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """``a, b``: near members (``bucket, all, node, component``) of one bucket but two components, each pair once.

    ``all`` holds the buckets of the node: near members share many of them, their pair arises in the smallest one.
    """
    x, y = members.alias("x"), members.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & near("x", "y")
    on = on & (F.col("x.bucket") == F.array_min(F.array_intersect("x.all", "y.all")))
    return x.join(y, on).select(*_ordered("x.node", "y.node"))


def linked_groups(
    buckets: DataFrame,
    verify: Verify,
    features: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column],
) -> DataFrame:
    """``node, component`` of all nodes that a verified pair links.

    ``buckets`` holds ``bucket, node``; rows may repeat. ``near`` is a cheap condition that links meet,
    on columns that ``features`` adds to given nodes, under two aliases; it spares pairs across
    groups. ``verify`` takes pairs ``a, b`` and returns those that link.
    """
    sizes = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"))
    sizes = materialize(sizes.where("lo < hi"), "buckets")
    large = materialize(sizes.where("n > 2").select("bucket", "lo", "n"), "large")
    members = materialize(buckets.join(small_side(large), "bucket").distinct(), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = members.join(weights, "node").select("bucket", F.struct("weight", "node").alias("rank"))
    hubs = ranked.groupBy("bucket").agg(F.max("rank").alias("rank")).select("bucket", F.col("rank.node").alias("hub"))
    members = materialize(members.drop("n").join(hubs, "bucket"), "members")
    ends = sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    for end in ("lo", "hub"):
        ends = ends.unionByName(members.where(f"node <> {end}").select(*_ordered("node", end)))
    ends = materialize(ends.distinct(), "ends")
    first = materialize(verify(ends).select("a", "b"), "links")
    groups = components(first)

    rest = members.select("bucket", "node").join(groups, "node", "left")
    rest = rest.withColumn("component", F.coalesce("component", "node"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    rest = materialize(rest.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")
    nodes = materialize(rest.groupBy("node").agg(F.collect_set("bucket").alias("all")), "nodes")
    rest = materialize(rest.join(nodes, "node").join(features(nodes.select("node")), "node"), "mixed")
    pairs = materialize(across_groups(rest, near).join(ends, ["a", "b"], "left_anti"), "pairs")
    second = materialize(verify(pairs).select("a", "b"), "links")
    if second.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))


def pair_nodes(pairs: DataFrame) -> DataFrame:
    """``node``: what the pairs name, stored and marked for broadcast where its size allows it."""
    both = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    return small_side(materialize(both, "nodes"))


def overlapping(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets (``node, grams``: distinct hashes) overlap by ``percent`` of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    sized = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("s"), (F.size("ga") + F.size("gb")).alias("t"))
    return sized.where(F.lit(100) * F.col("s") >= F.lit(percent) * (F.col("t") - F.col("s"))).where("s > 0").select("a", "b")
