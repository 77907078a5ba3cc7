"""Steps that read less than they did: one view of a face, one write of the seams, polygons only inside their box."""

from pyspark.sql import functions as F

from surfex.functions import matrices as M
from surfex.operators import raster as Z
from surfex.operators import texture as X


def test_a_wanted_triangle_meets_its_view_only(spark):
    cameras = spark.createDataFrame([(s, v, [1.0, 0.0, 0.0, float(v), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 4.0], [9.0, 0.0, 3.0, 0.0, 9.0, 2.0, 0.0, 0.0, 1.0], 7, 5) for s in (0, 1) for v in range(3)],
                                    "scene_id long, view_id int, ext array<double>, k array<double>, w int, h int")
    corners = spark.createDataFrame([(s, f, *[float((f + i) % 5) / 4 for i in range(9)], f % 5 if f else None) for s in (0, 1, None) for f in range(20)],
                                    "scene_id long, fid long, " + ", ".join(f"{a}{i} double" for i in range(3) for a in "xyz") + ", want int")
    every = Z.project_corners(corners.drop("want"), cameras).join(corners.select("scene_id", "fid", "want"), ["scene_id", "fid"]).where("view_id = want").drop("want")
    one = Z.project_corners(corners, cameras, "want").select(every.columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, every.collect())) and one.count() == 22


def test_seams_are_joined_once(spark):
    edges = spark.range(500).select((F.col("id") % 3).alias("scene_id"), (F.col("id") % 50).cast("double").alias("delta_e"), (F.col("id") % 5 == 0).alias("boundary"), (F.col("id") % 4 == 0).alias("reference"))
    labels = spark.createDataFrame([(s, f"name{s}") for s in range(3)], "scene_id long, label_a string")
    out = X.seam_report(edges.join(labels, "scene_id"))
    assert "label_a" not in out._jdf.queryExecution().optimizedPlan().toString() and "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.scene_id, r.scope): r.edges for r in out.collect()}
    assert got[0, "all"] == 167 and len(got) == 9 and got[1, "reference-boundary"] == sum(i % 3 == 1 and i % 4 == 0 for i in range(500))


def test_region_picks_are_those_of_the_polygons(spark):
    polys = [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)], [(1.0, 1.0), (7.0, 2.0), (3.0, 8.0)], [(2.0, 2.0), (None, 5.0), (6.0, 6.0)], [(float("nan"), 1.0), (5.0, 1.0), (5.0, 6.0)], [], None]
    regions = spark.createDataFrame([(0, i % 2, i, p) for i, p in enumerate(polys)], "scene_id long, view_id int, region_order int, poly array<struct<x: double, y: double>>")
    scores = spark.createDataFrame([(0, f, v, 0.5) for f in range(100) for v in (0, 1, 2)] + [(0, None, 0, 1.0)], "scene_id long, fid long, view_id int, score double")
    x, y = F.col("fid") % 10, F.floor(F.col("fid") / 10)
    plain = scores.join(regions, ["scene_id", "view_id"]).where(M.in_polygon(x, y, F.col("poly")))
    picks = X.region_picks(scores, regions, x, y)
    assert picks.columns == plain.columns and sorted(map(repr, picks.collect())) == sorted(map(repr, plain.collect())) and picks.count() > 12
