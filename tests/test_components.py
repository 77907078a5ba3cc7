"""Components by contraction."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surfex.operators import mesh as H

LINKS, FACES = "scene_id long, fid_a long, fid_b long", "scene_id long, fid long"


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_local_roots(edges):
    nodes, root = H.local_roots(*(np.array(c, np.int64) for c in zip(*edges)))
    assert dict(zip(nodes.tolist(), root.tolist())) == roots(edges)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_random_graphs(spark, chunk):
    rng = random.Random(chunk)
    edges = {s: [(rng.randrange(300), rng.randrange(300)) for _ in range(m)] for s, m in ((0, 140), (1, 400), (5, 1))}
    rows = [(s, a, b) for s, e in edges.items() for a, b in e] + [(0, 3, 3), (0, *edges[0][0])]
    faces = spark.createDataFrame([(s, f) for s in (0, 1, 5, 6) for f in range(300)], FACES)
    got = {(r.scene_id, r.fid): r.component for r in H.components(spark.createDataFrame(rows, LINKS), faces, chunk=chunk).collect()}
    want = {s: roots(e) for s, e in edges.items()}
    assert got == {(s, f): want.get(s, {}).get(f, f) for s in (0, 1, 5, 6) for f in range(300)}


@pytest.mark.parametrize("shape", ["chain", "shuffled chain", "star", "late star"])
def test_long_chains_and_hubs(spark, shape):
    n = 60_000
    i = F.col("id")
    mixed = lambda c: c * 7919 % n  # noqa: E731  a permutation, since 7919 is prime and no factor of n
    ends = {"chain": (i, i + 1), "shuffled chain": (mixed(i), mixed(i + 1)), "star": (F.lit(0), i + 1), "late star": (i, F.lit(n - 1))}[shape]
    links = spark.range(n - 1).select(F.lit(0).cast("long").alias("scene_id"), ends[0].cast("long").alias("fid_a"), ends[1].cast("long").alias("fid_b"))
    faces = spark.range(n).select(F.lit(0).cast("long").alias("scene_id"), i.alias("fid"))
    got = H.components(links, faces, chunk=5000)
    assert got.where("component <> 0").isEmpty() and got.count() == n


def test_no_edges(spark):
    faces = spark.createDataFrame([(0, 5), (1, 6)], FACES)
    assert sorted(map(tuple, H.components(spark.createDataFrame([], LINKS), faces).collect())) == [(0, 5, 5), (1, 6, 6)]
