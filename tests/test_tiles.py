"""Full-size photos as tiles: the same samples as by joins of cells, and one shuffle of points for any number of columns."""

from pyspark.sql import functions as F

from surfex.operators import gather as G
from surfex.operators import texture as X


def _scene(spark, w=7, h=5):
    cells = [(s, v, x, y, (x * 7 + y * 3 + v) % 5 + 0.5, float((x + y + s) % 3) if x != 2 else None) for s in (0, 1) for v in (0, 1) for x in range(w) for y in range(h) if (x + 2 * y + v) % 6]
    cells += [(0, 0, 3, 3, 9.0, 0.0), (0, 0, None, 1, 1.0, 1.0), (None, 0, 1, 1, 1.0, 1.0), (0, 1, -1, 2, 4.0, 4.0)]
    pixels = spark.createDataFrame(cells, "scene_id long, view_id int, x int, y int, a double, b double")
    points = [(s, v, i, (i % 19 - 5) / 1.7 if i else None, (i % 11 - 3) / 1.3, w if i % 5 else 1, h) for s in (0, 1, 2) for v in (0, 1, 2) for i in range(90)]
    return pixels, spark.createDataFrame([*points, (None, 0, 90, 1.0, 1.0, w, h)], "scene_id long, view_id int, point_id long, u double, v double, w int, h int")


def test_tiles_sample_as_joins_do(spark):
    pixels, points = _scene(spark)
    w, h = F.col("w"), F.col("h")
    joined = G.sample_bilinear_clamped(points, pixels, ["a", "b"], w, h, 2.0)
    for size in (2, 3, 64):
        carried = G.in_tiles(points, G.tiles(pixels, ["a", "b"], size), ["a", "b"], w, h, size)
        carried = G.sample_bilinear_clamped(carried, pixels, ["a", "b"], w, h, 2.0).select(joined.columns)
        assert sorted(map(repr, carried.collect())) == sorted(map(repr, joined.collect())) and joined.count() == 811


def test_baking_from_tiles_shuffles_a_texel_by_face_and_by_place_only(spark):
    pixels, points = _scene(spark)
    colors = pixels.select("scene_id", "view_id", "x", "y", F.col("a").alias("r"), F.col("b").alias("g"), F.col("a").alias("b"))
    texels = spark.createDataFrame([(s, i, 0, i % 7) for s in (0, 1, 2) for i in range(90)], "scene_id long, tx int, ty int, fid long")
    faces = texels.select("scene_id", "fid").distinct()
    labels = faces.withColumn("label", (F.col("fid") % 4 - 1).cast("int"))
    fill = faces.select("scene_id", "fid", *[F.lit(i).alias(c) for i, c in enumerate("rgb")])
    views = points.withColumnRenamed("point_id", "tx").withColumn("tx", F.col("tx").cast("int")).select("*", F.lit(0).alias("ty"), (F.col("tx") % 3 > 0).alias("valid"), F.lit(2.5).alias("mask_distance"), F.lit(0.5).alias("score"))
    joined = X.bake_texels(texels, labels, fill, views, colors)
    carried = X.bake_texels(texels, labels, fill, G.in_tiles(views, G.tiles(colors, ["r", "g", "b"], 3), ["r", "g", "b"], F.col("w"), F.col("h"), 3), colors)
    assert sorted(map(repr, carried.collect())) == sorted(map(repr, joined.collect()))
    assert carried.count() == 270 and carried.where("source_code > 0").count() == 3 * sum(i % 7 % 4 > 0 and i % 3 > 0 for i in range(90))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = carried._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line.split("hashpartitioning", 1)[1] for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("(scene_id" in m and " ty#" in m for m in moved) <= 2 and not any("_x0#" in m for m in moved), moved


def test_a_batch_of_stored_tiles_is_small(spark):
    cells = spark.range(80 * 60).select(F.lit(0).alias("scene_id"), F.lit(0).alias("view_id"), (F.col("id") % 80).cast("int").alias("x"), F.floor(F.col("id") / 80).cast("int").alias("y"), F.col("id").cast("double").alias("a"))
    cut = G.tiles(cells, ["a"])
    size = cut.select(F.max(F.size("p_a"))).first()[0]
    assert 4096 * size * 8 < 20e6  # a vectorised reader holds 4,096 rows of a column
    side = int(size ** 0.5)
    for r in cut.collect():
        for i, v in enumerate(r.p_a):
            x, y = r.tile_x * (side - 1) + i % side, r.tile_y * (side - 1) + i // side
            assert v == (y * 80 + x if 0 <= x < 80 and 0 <= y < 60 else None)
