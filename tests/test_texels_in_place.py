"""Texels carry what they need of their face: the same rows as by joins of texels, with one shuffle of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from surfex.operators import gather as G
from surfex.operators import raster as Z
from surfex.operators import texture as X

W, H = 150, 90
UV = ["ua", "va", "ub", "vb", "uc", "vc"]


def _faces(n=60):
    """Faces small and large, some outside the atlas, without area, with nulls, and one that comes twice."""
    made = np.random.default_rng(5)
    rows = []
    for f in range(n):
        middle, size = made.uniform(-0.1, 1.1, 2), (0.02, 0.1, 0.7)[f % 3]
        rows.append((f % 2, f, *[float(v) for v in (middle + made.uniform(-size, size, (3, 2))).ravel()]))
    rows += [rows[4], (0, 100, *[0.5] * 6), (0, 101, None, *rows[7][3:]), (None, 102, *rows[8][2:]), (0, None, *rows[5][2:])]
    return rows


def _uv(spark):
    return spark.createDataFrame(_faces(), "scene_id long, fid long, " + ", ".join(f"{c} double" for c in UV))


def _by_rows(uv):
    cols = {f"p{a}{i}": (F.col(f"u{n}") * W - 0.5 if a == "x" else (1.0 - F.col(f"v{n}")) * H - 0.5) for i, n in enumerate("abc") for a in "xy"}
    return Z.rasterize(uv.select("scene_id", "fid", *[v.alias(k) for k, v in cols.items()], *[F.lit(1.0).alias(f"pz{i}") for i in range(3)]), ["scene_id"], F.lit(W), F.lit(H))


def _same(a, b):
    a, b = sorted(map(repr, a.collect())), sorted(map(repr, b.collect()))
    assert a == b
    return len(a)


def test_squares_paint_as_rows_do(spark):
    uv = _uv(spark)
    atlas = Z.atlas_raster(uv.withColumn("tag", F.concat(F.lit("face "), "fid")), W, H, ("tag",))
    assert _same(atlas.drop("tag"), _by_rows(uv)) > W * H / 2
    assert atlas.where("tag <> concat('face ', fid)").count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = [line for line in atlas._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(lines) == 1 and "_tx#" in lines[0], lines


def test_a_square_is_painted_in_runs(monkeypatch):
    schema = to_arrow_schema(StructType.fromDDL("scene_id long, x int, y int, z double, fid long, b0 double, b1 double"))
    made, rows = np.random.default_rng(2), []
    for f in range(40):
        p = made.uniform(0, 63, (3, 2))
        den = (p[1, 1] - p[2, 1]) * (p[0, 0] - p[2, 0]) + (p[2, 0] - p[1, 0]) * (p[0, 1] - p[2, 1])
        box = {f"_{a}{n}": int(v) for i, a in enumerate("xy") for n, v in (("lo", np.ceil(p[:, i].min())), ("hi", np.floor(p[:, i].max())))}
        rows.append({"scene_id": 1, "fid": f, "_den": float(den), **{f"p{a}{i}": float(p[i, k]) for i in range(3) for k, a in enumerate("xy")}, **box, "_tx": 0, "_ty": 0})
    whole = Z._square_painter(["scene_id"], (), schema)(pa.Table.from_pylist(rows))
    monkeypatch.setattr(Z, "TESTED", 300)
    parts = Z._square_painter(["scene_id"], (), schema)(pa.Table.from_pylist(rows))
    assert whole.num_rows > 1000 and sorted(map(repr, whole.to_pylist())) == sorted(map(repr, parts.to_pylist()))


def _scene(spark):
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 4.0]
    cameras = spark.createDataFrame([(s, v, eye, [4.0 + v, 0.0, 3.0, 0.0, 4.0 + v, 2.0, 0.0, 0.0, 1.0], 7, 5) for s in (0, 1) for v in (0, 1)], "scene_id long, view_id int, ext array<double>, k array<double>, w int, h int")
    pixels = spark.createDataFrame([(s, v, x, y, 30.0 * x + v, 40.0 * y, 9.0 * s + 1) for s in (0, 1) for v in (0, 1) for x in range(7) for y in range(5) if (x + y) % 5], "scene_id long, view_id int, x int, y int, r double, g double, b double")
    faces = [r for r in _faces() if None not in r and r[1] < 60]
    faces = list({r[:2]: r for r in faces}.values())
    uv = spark.createDataFrame(faces, "scene_id long, fid long, " + ", ".join(f"{c} double" for c in UV))
    corners = uv.where("fid % 7 <> 5").selectExpr("scene_id", "fid", *[f"{a}{n} * 3 - 1.5 AS {b}{i}" for i, n in enumerate("abc") for a, b in (("u", "x"), ("v", "y"))], *[f"CAST(fid % 5 AS DOUBLE) AS z{i}" for i in range(3)])
    labels = uv.where("fid % 11 <> 3").selectExpr("scene_id", "fid", "CAST(fid % 4 - 1 AS INT) AS label", "fid / 60 AS score")
    fill = uv.where("fid % 13 <> 2").selectExpr("scene_id", "fid", "CAST(fid AS INT) AS r", "2 AS g", "3 AS b")
    return cameras, pixels, uv, corners, labels, fill


def test_texels_baked_in_place_are_those_of_joins(spark):
    cameras, pixels, uv, corners, labels, fill = _scene(spark)
    gains = cameras.where("view_id = 1").selectExpr("scene_id", "view_id", "1.2 AS gain_r", "0.9 AS gain_g", "1.0 AS gain_b")
    photos = G.pictures(cameras, [(pixels, ["r", "g", "b"])])

    def tested(seen):
        return seen.selectExpr("*", "coalesce(z_cam > 0 AND u > 0.5 AND v < 3.5, false) AS valid", "u AS mask_distance")

    points = Z.surface_points(Z.atlas_raster(uv, W, H), corners)
    chosen = points.join(labels.where("label >= 0").withColumnRenamed("label", "want"), ["scene_id", "fid"])
    for g in (None, gains):
        old = X.bake_texels(points.select("scene_id", "tx", "ty", "fid"), labels, fill, tested(G.in_views(chosen, cameras, ("w", "h"), "want", photos)), pixels, g)
        carried = Z.surface_points(Z.atlas_raster(X.faces_to_bake(uv, corners, labels, fill), W, H, X.BAKED))
        new = X.bake_texels(tested(G.in_views(carried, cameras, ("w", "h"), "want", photos, how="left")), None, None, None, pixels, g)
        assert new.schema.simpleString() == old.schema.simpleString() and _same(new, old) > 3000
        assert new.where("source_code > 0").count() > 500 and new.where("source_code = 0").count() > 500
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.bake_texels(tested(G.in_views(carried, cameras, ("w", "h"), "want", photos, how="left")), None, None, None, pixels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line.split("hashpartitioning", 1)[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]  # the texels and the photos
    assert sum("want#" in m for m in moved) == 2 and not any(" ty#" in m or " tx#" in m for m in moved), moved


def test_padding_of_single_texels_copies_what_joins_copy(spark):
    texels = spark.createDataFrame([(s, (i * 37) % 140, (i * 11) % 50, i, i % 7, 255 - i) for s in (0, 1) for i in range(90 if s else 4)] + [(2, 0, 0, 4, 5, 6)], "scene_id long, tx int, ty int, r int, g int, b int")
    old, new = X.pad_texels(texels, 140, 50, 3), X.pad_texels(texels, 140, 50, 3, single=True)
    assert new.schema.simpleString() == old.schema.simpleString() and _same(new, old) > 1000
    assert "SortMergeJoin" not in new._jdf.queryExecution().executedPlan().toString()
