import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surfex.functions import matrices as M
from surfex.operators import grids as R

SIZES = {(0, 0): (13, 9), (0, 1): (150, 7), (1, 0): (1, 1), (2, 5): (70, 66)}


def frames(spark, sizes=SIZES):
    return spark.createDataFrame([(s, v, w, h, (s + v) % 4) for (s, v), (w, h) in sizes.items()], "scene_id long, view_id int, w int, h int, r int")


def masks(seed, share, sizes=SIZES):
    rng = np.random.default_rng(seed)
    return {k: rng.random((h, w)) < share for k, (w, h) in sizes.items()}


def cells(spark, grids, value=None):
    rows = [(s, v, int(x), int(y), 255) for (s, v), g in grids.items() for y, x in zip(*np.nonzero(g))]
    out = spark.createDataFrame(rows + [(0, 0, -1, 2, 255), (0, 0, 3, 99, 255), (9, 9, 1, 1, 255)], "scene_id long, view_id int, x int, y int, level int")
    return out.repartition(3)


def dense(frame, column, sizes=SIZES):
    out = {k: np.full((h, w), np.nan) for k, (w, h) in sizes.items()}
    for r in frame.collect():
        assert math.isnan(out[r.scene_id, r.view_id][r.y, r.x])
        out[r.scene_id, r.view_id][r.y, r.x] = r[column]
    return out


def brute_nearest(grid):
    ys, xs = np.nonzero(grid)
    out = np.full((*grid.shape, 3), np.inf)
    for y in range(grid.shape[0]):
        for x in range(grid.shape[1]):
            if len(ys):
                out[y, x] = min(((a - x) ** 2 + (b - y) ** 2, b, a) for a, b in zip(xs.tolist(), ys.tolist()))
    return out


@settings(deadline=None, max_examples=100)
@given(st.integers(1, 12), st.integers(1, 5), st.randoms())
def test_lower_envelope(h, n, rnd):
    f = np.array([[rnd.choice([math.inf, rnd.randrange(40) ** 2]) for _ in range(n)] for _ in range(h)], float)
    best, row = R.lower_envelope(f)
    every = f[None] + (np.arange(h)[:, None, None] - np.arange(h)[None, :, None]) ** 2
    assert (best == every.min(axis=1)).all()
    some = np.isfinite(best)
    assert (row[some] == every.argmin(axis=1)[some]).all()


@pytest.mark.parametrize("share", [0.02, 0.4, 1.0])
def test_distances(spark, share):
    grids = masks(3, share)
    found = R.distance_field(cells(spark, grids), frames(spark)).collect()
    expect = {k: brute_nearest(g) for k, g in grids.items()}
    assert len(found) == sum(g.size for g in grids.values() if g.any())
    for r in found:
        square, y, x = expect[r.scene_id, r.view_id][r.y, r.x]
        assert (r.distance, r.near_y, r.near_x) == (math.sqrt(square), y, x)
    signed = dense(R.signed_distance(cells(spark, grids), frames(spark)), "signed")
    for k, g in grids.items():
        far = math.hypot(*g.shape)
        to, out = (np.minimum(np.sqrt(brute_nearest(m)[:, :, 0]), far) for m in (g, ~g))
        assert np.allclose(signed[k], np.where(g, -out, to), atol=0, rtol=1e-15)
    near = R.distance_field(cells(spark, grids), frames(spark), within=2)
    assert near.count() == sum((np.sqrt(e[:, :, 0]) <= 2).sum() for e in expect.values())


def reflect(i, n):
    if n == 1:
        return 0
    i %= 2 * (n - 1)
    return min(i, 2 * (n - 1) - i)


@pytest.mark.parametrize("sigma", [0.8, 6.0])
def test_blur(spark, sigma):
    sizes = {(0, 0): (13, 9), (0, 1): (70, 3), (1, 0): (1, 4)}
    grids = masks(5, 0.5, sizes)
    table = cells(spark, grids).select("*", F.lit(True).alias("mask"), (F.col("x") * 7 + F.col("y") * 3).cast("double").alias("l"))
    found = R.masked_gaussian(table.unionByName(table.withColumn("mask", F.lit(False)).withColumn("x", F.col("x") + 1)), frames(spark, sizes), "l", sigma)
    blur, weight = dense(found, "blur_l", sizes), dense(found, "weight", sizes)
    w = R.gaussian_weights(sigma)
    r = len(w) // 2
    for k, g in grids.items():
        h, n = g.shape
        value = (np.arange(n)[None] * 7 + np.arange(h)[:, None] * 3) * g
        kx = np.zeros((n, n))
        ky = np.zeros((h, h))
        for size, kernel in ((n, kx), (h, ky)):
            for i in range(size):
                for d in range(-r, r + 1):
                    kernel[i, reflect(i + d, size)] += w[r + d]
        total, share = ky @ value @ kx.T, ky @ g.astype(float) @ kx.T
        assert np.allclose(weight[k], share) and np.allclose(blur[k], total / np.maximum(share, 1e-5))


def under(grid, spans, pick):
    h, w = grid.shape
    r = len(spans) // 2
    return np.array([[pick([grid[y + d, x + e] for d in range(-r, r + 1) for e in range(-spans[d + r], spans[d + r] + 1) if 0 <= y + d < h and 0 <= x + e < w])
                      for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("kernel", [R.ellipse, R.box])
@pytest.mark.parametrize("radius", [0, 3, 40])
def test_morphology(spark, kernel, radius):
    sizes = {(0, 0): (13, 9), (0, 1): (150, 7)} if radius < 40 else {(0, 0): (30, 9), (0, 1): (95, 2)}
    rng = np.random.default_rng(radius)
    grids = {k: (rng.random((h, w)) < 0.3) * rng.integers(1, 256, (h, w)) for k, (w, h) in sizes.items()}
    rows = [(s, v, int(x), int(y), int(g[y, x])) for (s, v), g in grids.items() for y, x in zip(*np.nonzero(g))]
    levels = spark.createDataFrame(rows, "scene_id long, view_id int, x int, y int, level int")
    for steps in (("grow",), ("shrink",), ("grow", "shrink")):
        found = dense(R.morph(levels, frames(spark, sizes), steps, kernel, radius), "level", sizes)
        for k, g in grids.items():
            for s in steps:
                g = under(g, kernel(radius), max if s == "grow" else min)
            assert (np.nan_to_num(found[k]) == g).all()


def test_radius_of_each_photo_and_kernel_shape(spark):
    assert R.ellipse(0) == [0] and R.ellipse(3) == [0, 2, 3, 3, 3, 2, 0] and R.box(1) == [1, 1, 1]
    sizes = {(s, 0): (11, 11) for s in range(4)}
    middle = spark.createDataFrame([(s, 0, 5, 5) for s in range(4)], "scene_id long, view_id int, x int, y int")
    grown = R.dilate(middle, frames(spark, sizes), R.ellipse, F.col("r")).groupBy("scene_id").count().collect()
    assert {r.scene_id: r["count"] for r in grown} == {s: sum(2 * t + 1 for t in R.ellipse(s)) for s in range(4)}
    back = R.erode(R.dilate(middle, frames(spark, sizes), R.ellipse, 3), frames(spark, sizes), R.ellipse, 3)
    assert sorted(tuple(r) for r in back.collect()) == [(s, 0, 5, 5) for s in range(4)]
    assert R.close(middle, frames(spark, sizes), R.box, 2).count() == 4


def test_polygons_agree_with_the_point_rule(spark):
    rng = random.Random(2)
    polygons = [(s, v, i, [(rng.uniform(-5, w + 5), rng.choice([rng.uniform(-5, h + 5), float(rng.randrange(h))])) for _ in range(rng.randrange(1, 9))])
                for (s, v), (w, h) in SIZES.items() for i in range(6)]
    table = spark.createDataFrame(polygons, "scene_id long, view_id int, polygon_id int, points array<struct<x double, y double>>")
    spans = R.polygon_spans(table, frames(spark))
    got = spans.select("scene_id", "view_id", "polygon_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    every = frames(spark).select("scene_id", "view_id", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"), F.sequence(F.lit(0), F.col("h") - 1).alias("ys")).select("scene_id", "view_id", "x", F.explode("ys").alias("y"))
    inside = every.join(table, ["scene_id", "view_id"]).where(F.size("points") > 2).where(M.in_polygon(F.col("x"), F.col("y"), F.col("points"))).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, inside.collect())) and got.count() > 100
    assert R.polygon_cells(table, frames(spark)).count() == got.drop("polygon_id").distinct().count()


def test_similarity(spark):
    sizes = {(0, 0): (13, 9), (0, 1): (80, 7), (1, 0): (6, 20)}
    rng = np.random.default_rng(1)
    pics = {k: rng.integers(0, 256, (4, h, w)) for k, (w, h) in sizes.items()}
    rows = [(s, v, x, y, *[float(c) for c in p[[0, 2, 1, 3], y, x]]) for (s, v), p in pics.items() for y in range(p.shape[1]) for x in range(p.shape[2]) if (x + y) % 5]
    table = spark.createDataFrame(rows, "scene_id long, view_id int, x int, y int, a0 double, b0 double, a1 double, b1 double")
    got = dense(R.similarity(table, frames(spark, sizes), 2), "ssim", sizes)
    for k, p in pics.items():
        h, w = p.shape[1:]
        p = p * ((np.arange(w)[None] + np.arange(h)[:, None]) % 5 > 0)
        for y in range(h):
            for x in range(w):
                if 3 <= y < h - 3 and 3 <= x < w - 3:
                    score = 0
                    for c in range(2):
                        a, b = (p[i, y - 3:y + 4, x - 3:x + 4].ravel().astype(float) for i in (c, c + 2))
                        cov = np.cov(a, b)
                        score += (2 * a.mean() * b.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225)) / 2
                    assert abs(got[k][y, x] - score) < 1e-9
                else:
                    assert math.isnan(got[k][y, x])


def test_no_photos(spark):
    none = frames(spark).where("w < 0")
    assert R.signed_distance(cells(spark, masks(1, 0.5)), none).collect() == []
    assert R.dilate(cells(spark, masks(1, 0.5)), none).collect() == []
