"""Steps that grow with the tables: what they send, hold and write, and the rows they still give."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from surfex.catalog import fusion as catalog
from surfex.catalog import storage
from surfex.operators import fusion as U
from surfex.operators import matching as A
from surfex.operators import raster as Z
from surfex.sources import readers


def test_votes_stay_where_they_are_counted(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 4.0]
    cameras = spark.createDataFrame([(0, v, eye, [4.0, 0.0, 3.0, 0.0, 4.0, 2.0, 0.0, 0.0, 1.0], 7, 5) for v in (0, 1, 2)], "scene_id long, view_id int, ext array<double>, k array<double>, w int, h int")
    masks = spark.createDataFrame([(0, v, 3, 2) for v in (0, 1, 2)], "scene_id long, view_id int, x int, y int")
    points = spark.createDataFrame([(0, 7, 0.0, 0.0, 0.0), (0, 8, 3.0, 0.0, 0.0)], "scene_id long, point_id long, x double, y double, z double")
    votes = U.consensus_points(points, cameras, masks, 1)
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Join")
    assert [tuple(r) for r in votes.collect()] == [(0, 7, 0.0, 0.0, 0.0, 3)]


def test_a_surface_counts_the_votes_once(spark, monkeypatch):
    calls, points = [], spark.createDataFrame([(0, 0.0, 0.0, 0.0), (0, 1.0, 0.5, 0.2)], "scene_id long, x double, y double, z double")
    monkeypatch.setattr(catalog, "_kept", lambda t: calls.append(t) or points)
    monkeypatch.setattr(U, "voxel_evidence", lambda voxels, *rest: voxels)
    monkeypatch.setattr(U, "fuse_voxels", lambda evidence, limits: evidence)
    monkeypatch.setattr(U, "extract_surface", lambda field, spec: (field, spec))
    frame = spark.createDataFrame([(0, 0)], "scene_id long, view_id int")
    field, spec = catalog._surface(SimpleNamespace(photo_cameras=frame, cameras=frame, grids=frame))
    assert len(calls) == 1 and spec.count() == 1 and field.count() == spec.selectExpr("nx * ny * nz").first()[0]


def _nearest(a, b, v):
    """(id, other, distance, rank) of the two nearest by plain comparison."""
    out = []
    for i in a:
        order = sorted((float(np.sqrt(((v[j] - v[i]) ** 2).sum())), j) for j in b)
        out += [(i, j, d, n + 1) for n, (d, j) in enumerate(order[:2])]
    return out


def test_two_nearest_in_few_blocks(spark, monkeypatch):
    made = np.random.default_rng(3)
    v = made.normal(size=(320, 5))
    v[40:60], v[100:103], v[200:] = v[0], v[1], v[200:] * 1e6  # copies on both sides, and far values
    frame = spark.createDataFrame([(1, i, [float(x) for x in v[i]]) for i in range(320)], "pair_id long, id long, v array<double>")
    sides = frame.where("id % 2 = 0"), frame.where("id % 2 = 1")
    got = sorted(map(tuple, A.two_nearest(*sides, 4).select("side", "id", "other", "distance", "rank").collect()))
    even, odd = range(0, 320, 2), range(1, 320, 2)
    assert got == sorted([("a", *r) for r in _nearest(even, odd, v)] + [("b", *r) for r in _nearest(odd, even, v)])

    def count():
        def one(key, left, right):
            return left.head(1).assign(side="a", other=0, distance=0.0)[["pair_id", "side", "id", "other", "distance"]]
        return one

    monkeypatch.setattr(A, "_block_matcher", count)
    assert A.two_nearest(*sides, 4).select("id").distinct().count() <= 64


def test_two_nearest_of_values_that_are_not_finite():
    a, b = np.array([[0.0], [np.nan]]), np.array([[3.0], [np.inf], [1.0], [np.nan]])
    row, at, d = A._two_in_block(a, b, np.array([4, 5, 6, 7]))
    assert row.tolist() == [0, 0, 1, 1] and at.tolist() == [2, 0, 0, 1] and d[:2].tolist() == [1.0, 3.0] and np.isnan(d[2:]).all()


def test_far_fewer_files_than_documents(spark):
    t = SimpleNamespace(spark=spark)
    docs = spark.range(700).select(F.col("id").alias("scene"), F.lit(2).alias("formatVersion"), F.array(F.struct(F.concat(F.lit("a"), "id").alias("id"), F.lit(640).alias("workingWidth"))).alias("records"))
    path = storage._documents(t, docs, "scene")
    assert len([p for p in Path(path).rglob("part-*")]) < 10
    back = readers.read_views(spark, path).select("formatVersion", "view_id", "id", "workingWidth").collect()
    assert sorted(map(tuple, back)) == sorted((2, 0, f"a{i}", 640) for i in range(700))


def test_hidden_points_are_dropped_before_the_minimum(spark):
    rows = [(0, 0, 1, 1, z, p, r) for z, p, r in ((2.0, 5, 1), (1.0, 9, 4), (1.0, 8, 3), (1.0, 8, None), (3.0, None, 2))]
    rows += [(0, None, 1, 1, 2.0, 1, 1), (0, 0, 2, 1, 5.0, 1, 1), (1, 0, 1, 1, 4.0, 1, 1)]
    names = ["scene_id", "view_id", "x", "y", "z", "point_id", "r"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    kept = [tuple(r.values()) for out in Z._front(iter([batch])) for r in out.to_pylist()]
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[4:6] not in ((2.0, 5), (1.0, 9))], key=repr)
    seen = spark.createDataFrame([(0, v, float(i % 4), float(i % 3), 1.0 + (i * 7) % 11, i, 5, 5) for v in (0, 1) for i in range(300)],
                                 "scene_id long, view_id int, u double, v double, z_cam double, point_id long, w int, h int")
    best = {}
    for r in seen.collect():
        key = (r.scene_id, r.view_id, int(r.u), int(r.v))
        best[key] = min(best.get(key, (1e9, 0)), (r.z_cam, r.point_id))
    assert {tuple(r)[:4]: (r.z, r.point_id) for r in Z.splat(seen, []).collect()} == best
