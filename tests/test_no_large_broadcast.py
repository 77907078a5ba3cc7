"""Tables that grow with the faces or their values never pass through the driver, however few bytes their files have."""

from pyspark.sql import functions as F

from surfex.operators import ranking as Q
from surfex.operators import texture as X
from surfex.session import cut_lineage


def _broadcasts(df):
    """Broadcasts of the plan as run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_values_that_compress_well_are_not_broadcast(spark):
    rows = cut_lineage(spark.range(6000).select((F.col("id") % 7).alias("scene_id"), (F.col("id") % 50).cast("double").alias("v")))
    out = Q.exact_quantiles(rows, ["scene_id"], "v", {"p95": 0.95})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert _broadcasts(out) == 0 and "BroadcastHashJoin" not in plan
    values = sorted(i % 50 for i in range(6000) if i % 7 == 3)
    at = 0.95 * (len(values) - 1)
    low = values[int(at)]
    want = low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))
    assert abs({r.scene_id: r.p95 for r in out.collect()}[3] - want) < 1e-9


def test_labels_of_seams_are_not_broadcast(spark):
    labels = cut_lineage(spark.range(300).select((F.col("id") % 3).alias("scene_id"), F.floor(F.col("id") / 3).alias("fid"), (F.col("id") % 4 - 1).cast("int").alias("label")))
    adjacency = cut_lineage(spark.range(297).select((F.col("id") % 3).alias("scene_id"), F.floor(F.col("id") / 3).alias("fid_a"), (F.floor(F.col("id") / 3) + 1).alias("fid_b")))
    edges = X.seam_edges(adjacency, labels)
    assert _broadcasts(edges) == 0 and edges.count() == 297
    label = lambda s, f: (3 * f + s) % 4 - 1
    assert edges.where("boundary").count() == sum(label(s, f) >= 0 and label(s, f + 1) >= 0 and label(s, f) != label(s, f + 1) for s in range(3) for f in range(99))


def test_faces_that_compress_well_are_not_broadcast(spark):
    every = spark.range(600)
    faces = cut_lineage(every.select((F.col("id") % 2).alias("scene_id"), F.floor(F.col("id") / 2).alias("fid")))
    adjacency = cut_lineage(every.where("id < 596").selectExpr("id % 2 AS scene_id", "id div 2 AS fid_a", "id div 2 + 1 AS fid_b"))
    scores = cut_lineage(every.where("id % 5 < 3").selectExpr("id % 2 AS scene_id", "id div 2 AS fid", "CAST(id % 3 AS INT) AS view_id", "0.5 + id / 6000 AS score"))
    known = cut_lineage(every.selectExpr("id % 2 AS scene_id", "id div 2 AS fid", "id < 40 AS known", "1.0 AS r", "2.0 AS g", "3.0 AS b"))
    corners = cut_lineage(every.selectExpr("id % 2 AS scene_id", "id div 2 AS fid", *[f"0.5 AS {a}{i}" for i in range(3) for a in "xyz"], "1.0 AS area"))
    fill = X.diffuse_fill(known, adjacency, 8)
    labels = cut_lineage(X.smooth_labels(scores, adjacency, faces, 1))
    label = labels.withColumn("score", F.lit(0.5))
    texels = cut_lineage(every.selectExpr("id % 2 AS scene_id", "id div 2 AS fid", "1 AS source_code"))
    for out, n in ((X.smooth_labels(scores, adjacency, faces, 1), 600), (fill, 600), (X.faces_to_bake(faces, corners, label, fill), 600), (X.coverage_bounds(texels, corners), 2)):
        assert _broadcasts(out) == 0 and out.count() == n
