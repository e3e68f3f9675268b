"""Pairs across the groups of mixed buckets."""

from pyspark.sql import functions as F

from wattcell.llm.links import across_groups


def test_a_pair_that_shares_many_buckets_arises_once(spark):
    buckets = {n: {1, 2, 3, 4, 5} | {10 + n} for n in range(6)} | {6: {5, 99}, 7: {99}}
    rows = [(b, sorted(bs), n, n // 2) for n, bs in buckets.items() for b in bs]
    members = spark.createDataFrame(rows, "bucket long, all array<long>, node long, component long")
    found = [tuple(r) for r in across_groups(members, lambda x, y: F.lit(True)).collect()]
    want = {(a, b) for a in buckets for b in buckets if a < b and a // 2 != b // 2 and buckets[a] & buckets[b]}
    assert len(found) == len(want) and set(found) == want
