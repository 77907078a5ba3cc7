"""Registered queries do the whole job of their operator."""

import math

from pyspark.sql import functions as F

from surfex.catalog import load_all
from surfex.catalog import registry
from surfex.operators import mesh as H
from surfex.plans import jobs as P

QUERIES, _ = load_all()


def test_fill_reaches_the_end_of_a_large_hole(spark, monkeypatch):
    """A strip of 20 faces whose first alone has a photo: face i is i edges away."""
    monkeypatch.setitem(registry.BINDINGS, "faces", "SELECT 0L AS scene_id, id AS fid, id AS v0, id + 1 AS v1, id + 2 AS v2, false AS completion FROM range(20)")
    monkeypatch.setitem(registry.BINDINGS, "face_scores", "SELECT 0L AS scene_id, 0L AS fid, 0 AS view_id, 1e0 AS score, 200e0 AS r, 200e0 AS g, 200e0 AS b")
    steps = {r.fid: r.step for r in QUERIES["r3_diffuse_fill"](spark, "none").collect()}
    assert steps == {i: i for i in range(20)}
    assert [tuple(r[c] for c in ("filled", "unreached", "r")) for r in QUERIES["r3_fill_colors"](spark, "none").collect()] == [(19, 0, 200)]


FOCAL, RADIUS, AWAY = 60.0, 0.8, 4.0
TURNS = [(1, 0, 0, 0, 1, 0, 0, 0, 1), (0.8, 0, 0.6, 0, 1, 0, -0.6, 0, 0.8), (0.8, 0, -0.6, 0, 1, 0, 0.6, 0, 0.8), (1, 0, 0, 0, 0.8, 0.6, 0, -0.6, 0.8), (1, 0, 0, 0, 0.8, -0.6, 0, 0.6, 0.8)]


def ball(scene, step):
    """Exact photos of a ball at the origin, and the world points of every ``step``-th of its pixels."""
    grids, cloud = [], []
    for view, turn in enumerate(TURNS):
        for y in range(30):
            for x in range(40):
                d = ((x - 19.5) / FOCAL, (y - 14.5) / FOCAL, 1.0)
                dd = sum(c * c for c in d)
                root = AWAY * AWAY - dd * (AWAY * AWAY - RADIUS * RADIUS)
                z = (AWAY - math.sqrt(root)) / dd if root > 0 else 0.0
                grids.append((scene, view, x, y, z, 3.0, root > 0, 200.0, 100.0, 50.0))
                if root > 0 and (x + y) % step == 0:
                    c = (d[0] * z, d[1] * z, z - AWAY)
                    cloud.append((scene, len(cloud), *[sum(turn[3 * i + a] * c[i] for i in range(3)) for a in range(3)]))
    return grids, cloud


def test_fusion_of_a_ball(spark):
    whole, thin = ball(0, 1), ball(1, 5)
    assert len(whole[1]) > 1001 > len(thin[1])
    grids = spark.createDataFrame(whole[0] + thin[0], "scene_id long, view_id int, x int, y int, depth double, confidence double, mask boolean, r double, g double, b double")
    points = spark.createDataFrame(whole[1] + thin[1], "scene_id long, point_id long, x double, y double, z double")
    rows = [(s, v, [float(e) for i in range(3) for e in (*t[3 * i:3 * i + 3], AWAY if i == 2 else 0)], [FOCAL, 0.0, 19.5, 0.0, FOCAL, 14.5, 0.0, 0.0, 1.0], 40, 30, 0, 0, 40, 30)
            for s in (0, 1, 2) for v, t in enumerate(TURNS)]
    cameras = spark.createDataFrame(rows, "scene_id long, view_id int, ext array<double>, k array<double>, w int, h int, left int, top int, w_photo int, h_photo int")
    out = P.fuse(points, cameras, grids, 28, 80)
    status = {r.scene_id: (r.status, r.points) for r in out["scenes"].collect()}
    assert status[0][0] == "meshed" and status[1][0] == status[2][0] == "too-few-points" and status[2][1] == 0 < status[1][1] <= len(thin[1])
    parts = out["components"].collect()
    assert [(p.scene_id, p.reason) for p in parts if p.reason == "main"] == [(0, "main")] and {p.scene_id for p in parts} == {0}
    spacing = out["spec"].where("scene_id = 0").first().spacing
    far = out["vertices"].select(F.abs(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) - RADIUS).alias("gap"), "x", "y", "z")
    # Every view looks at the side with negative z; there the surface lies within a cell of the ball.
    seen = far.where(F.col("z") < -0.5 * RADIUS).agg(F.avg("gap").alias("mean"), F.max("gap").alias("most"), F.count("*").alias("n")).first()
    assert seen.n > 100 and seen.mean < 0.5 * spacing and seen.most < 2 * spacing
    assert H.is_watertight(out["faces"].select("scene_id", F.col("new_fid").alias("fid"), F.col("n0").alias("v0"), F.col("n1").alias("v1"), F.col("n2").alias("v2"))).first().watertight
    assert out["faces"].count() == sum(p.faces for p in parts if p.reason != "unsupported-or-detached-dust")
