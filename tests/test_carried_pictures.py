"""Points that carry their photos: the same samples as by joins, and no shuffle of points times views."""

from pyspark.sql import functions as F

from surfex.operators import fusion as U
from surfex.operators import gather as G
from surfex.operators import raster as Z
from surfex.operators import texture as X

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 4.0]


def _scene(spark, w=7, h=5):
    cameras = spark.createDataFrame([(s, v, IDENTITY, [4.0 + v, 0.0, (w - 1) / 2, 0.0, 4.0 + v, (h - 1) / 2, 0.0, 0.0, 1.0], w, h) for s in (0, 1) for v in (0, 1, 2)],
                                    "scene_id long, view_id int, ext array<double>, k array<double>, w int, h int")
    cells = [(s, v, x, y, (x * 7 + y * 3 + v) % 5 + 0.5, (x + y + s) % 3 if x != 2 else None) for s in (0, 1) for v in (0, 1) for x in range(w) for y in range(h) if (x + 2 * y + v) % 6]
    pixels = spark.createDataFrame(cells, "scene_id long, view_id int, x int, y int, a double, n int")
    points = spark.createDataFrame([(s, i, (i % 13 - 6) / 2.0, (i % 7 - 3) / 2.0, (i % 5 - 2) * 2.5) for s in (0, 1, 2) for i in range(90)] + [(None, 90, 0.0, 0.0, 0.0)],
                                   "scene_id long, point_id long, x double, y double, z double")
    return cameras, pixels, points


def _sampled(cameras, pixels, points, photos):
    seen = G.in_views(points, cameras, ("w", "h"), photos=photos, deal=F.col("point_id"))
    w, h = F.col("w"), F.col("h")
    out = G.sample_bilinear(seen, pixels, {"a": -9.0}, w, h).withColumnRenamed("s_a", "one")
    out = G.sample_bilinear_clamped(out, pixels, ["a"], w, h, 2.0).withColumnRenamed("s_a", "two")
    out = G.sample_nearest(out, pixels, {"n": 8}, w, h).withColumnRenamed("s_n", "three")
    return G.sample_nearest_clamped(out, pixels, {"n": None}, w, h).select("scene_id", "point_id", "view_id", "u", "one", "two", "three", "s_n")


def test_carried_pictures_sample_as_joins_do(spark):
    cameras, pixels, points = _scene(spark)
    joined = _sampled(cameras, pixels, points, None)
    carried = _sampled(cameras, pixels, points, G.pictures(cameras, [(pixels, ["a", "n"])]))
    assert carried.schema == joined.schema
    assert sorted(map(repr, carried.collect())) == sorted(map(repr, joined.collect())) and joined.count() == 540


def _partitionings(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_votes_evidence_and_field_shuffle_no_projected_point(spark):
    cameras, pixels, points = _scene(spark)
    votes = U.consensus_points(points, cameras, pixels.where("a > 1"), 1)
    grids = pixels.select("scene_id", "view_id", "x", "y", F.col("a").alias("signed"), F.col("a").alias("depth"), F.col("a").alias("confidence"), (F.col("n") > 0).alias("mask"))
    boxed = cameras.selectExpr("*", "0 AS left", "0 AS top", "w AS w_photo", "h AS h_photo")
    voxels = U.voxel_rows(U.grid_spec(points.where("scene_id < 2"), 16))
    field = U.fuse_voxels(U.voxel_evidence(voxels, boxed, grids), U.view_counts(cameras))
    for df in (votes, field):
        for line in _partitionings(df):
            assert not any(f"{c}#" in line for c in ("_px", "_x0", "k", "point_id")), line
    assert field.count() == voxels.count()


def test_visibility_shuffles_no_projected_point(spark):
    cameras, pixels, points = _scene(spark)
    zbuffer = pixels.select("scene_id", "view_id", "x", "y", F.col("a").alias("z"))
    distance = pixels.select("scene_id", "view_id", "x", "y", F.col("a").alias("distance"))
    photos = Z.visibility_pictures(cameras, zbuffer, distance)
    one, two = (Z.visible(G.in_views(points, cameras, ("k", "w", "h"), photos=p, deal=F.col("point_id")).withColumn("fx", F.col("k")[0]), zbuffer, distance)
                .select("scene_id", "point_id", "view_id", "valid", "mask_distance", "depth_gap") for p in (photos, None))
    assert not any("_px#" in line for line in _partitionings(one))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_baking_samples_the_carried_photo(spark):
    cameras, pixels, points = _scene(spark)
    colors = pixels.selectExpr("scene_id", "view_id", "x", "y", "a * 30 AS r", "a * 20 AS g", "a AS b")
    texels = points.selectExpr("scene_id", "CAST(point_id AS INT) AS tx", "0 AS ty", "point_id AS fid", "x", "y", "z", "0 AS want", "0.5 AS score")
    labels = texels.selectExpr("scene_id", "fid", "0 AS label")
    fill = texels.selectExpr("scene_id", "fid", "1 AS r", "2 AS g", "3 AS b")

    def baked(photos):
        views = G.in_views(texels, cameras, ("w", "h"), "want", photos, F.col("fid")).selectExpr("*", "z_cam > 0 AS valid", "3.0 AS mask_distance")
        return X.bake_texels(texels, labels, fill, views, colors)

    carried, joined = baked(G.pictures(cameras, [(colors, ["r", "g", "b"])])), baked(None)
    assert not any("_x0#" in line for line in _partitionings(carried))
    assert sorted(map(repr, carried.collect())) == sorted(map(repr, joined.collect())) and carried.count() == texels.count()


def test_padding_passes_no_raster_through_the_driver(spark):
    texels = spark.createDataFrame([(0, 3, 2, 9, 8, 7), (0, 5, 2, 1, 2, 3), (1, 0, 0, 4, 5, 6)], "scene_id long, tx int, ty int, r int, g int, b int")
    out = X.pad_texels(texels, 9, 6, 1)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.scene_id, r.tx, r.ty, r.r) for r in out.collect() if r.padding) == [
        (0, 2, 2, 9), (0, 3, 1, 9), (0, 3, 3, 9), (0, 4, 2, 9), (0, 5, 1, 1), (0, 5, 3, 1), (0, 6, 2, 1), (1, 0, 1, 4), (1, 1, 0, 4)]
