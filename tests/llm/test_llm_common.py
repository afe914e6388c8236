"""Prefix sums and components against plain Python; helpers for the other tests."""

import random

from pyspark.sql import functions as F

from flowlens.llm.common import components, prefix_sums, range_starts


def test_prefix_sums_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v long").withColumn("h", F.md5(F.col("i").cast("string")))
    got = prefix_sums(df, range_starts(df, ["k"], "h", "v", 16), ["k"], "h", ["i"], "v", 16).collect()
    want, sums = {}, {}
    for r in sorted(got, key=lambda r: r.h):
        want[r.i] = sums.get(r.k, 0)
        sums[r.k] = want[r.i] + r.v
    assert len(got) == 500 and {r.i: r.before for r in got} == want and all(r.total == sums[r.k] for r in got)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(40)] + [(5, 5), (7, 8), (8, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent)} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []
