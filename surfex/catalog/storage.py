"""Readers and sinks over tables written to the shared checkpoint folder of the session."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import intake as I
from ..session import checkpoint_folder
from ..sources import readers, sinks
from . import bindings  # noqa: F401
from .intake import CLASSIFIED, _classified
from .registry import query


def _folder(t):
    return f"{checkpoint_folder(t.spark)}/storage/{uuid.uuid4().hex}"


@query("s1_scan_files", """SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS selection, sum(strlen(concat(o_orderkey, ' ', o_orderstatus)) + 1)::BIGINT AS bytes, 0::BIGINT AS nested
FROM orders GROUP BY o_orderpriority""")
def _(t):
    """One folder of files per priority, each with a nested folder that the scan must not enter."""
    path = _folder(t)
    lines = t.orders.select(F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("line"), F.col("o_orderpriority").alias("folder"))
    lines.write.partitionBy("folder").text(path)
    folders = sorted(r.folder for r in lines.select("folder").distinct().collect())  # the five priorities
    for f in folders:
        t.spark.range(1).selectExpr("'nested' AS line").write.text(f"{path}/folder={f}/below")
    files = readers.scan_files(t.spark, [f"{path}/folder={f}" for f in folders])
    return files.groupBy(F.col("arrival.selection").alias("selection")).agg(F.sum("length").alias("bytes"), F.count_if(F.col("path").contains("/below/")).alias("nested"))


_PROJECTS = "SELECT floor(s_suppkey / 10)::BIGINT AS project_id, count(*) AS photos, min(s_suppkey) AS first_photo FROM supplier GROUP BY 1"


def _project_photos(t, *fields):
    """Projects of at most ten photos, one document each."""
    photo = F.struct(*fields)
    return t.supplier.select(F.floor(F.col("s_suppkey") / 10).cast("long").alias("project"), "s_suppkey", "s_name").groupBy("project").agg(F.sort_array(F.collect_list(photo)).alias("photos"))


#: Documents in one file, about.
PACK = 256


def _documents(t, docs, key):
    """One JSON document per row; a file is an array of documents, so that there are far fewer files than documents."""
    path = _folder(t)
    pack = F.pmod(F.xxhash64(key), F.lit(docs.count() // PACK + 1)).alias("folder")
    docs.groupBy(pack).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value")).write.partitionBy("folder").text(path)
    return path


@query("s3_read_manifests", f"""SELECT project_id, CASE WHEN project_id % 4 = 3 THEN 'unsupported-version' ELSE 'ok' END AS status, CASE WHEN project_id % 4 = 3 THEN 9 ELSE 1 + project_id % 4 END::INT AS stored_version,
 CASE WHEN project_id % 4 <> 3 THEN 3 ELSE -1 END::INT AS format_version, photos, concat('images/', first_photo) AS first_path FROM ({_PROJECTS})""")
def _(t):
    key = F.col("s_suppkey").cast("string")
    docs = _project_photos(t, key.alias("id"), F.concat(F.lit("images/"), key).alias("imagePath"), F.lit(640).alias("pixelWidth"), F.lit(480).alias("pixelHeight"))
    version = F.when(F.col("project") % 4 == 3, 9).otherwise(1 + F.col("project") % 4)
    back = readers.read_manifests(t.spark, _documents(t, docs.select(F.col("project").cast("string").alias("id"), version.alias("formatVersion"), "photos"), "id"))
    first = F.array_min(F.transform("photos", lambda p: F.struct(p["id"].cast("long").alias("n"), p["imagePath"].alias("path"))))["path"]
    return back.select(F.col("id").cast("long").alias("project_id"), "status", "stored_version", F.coalesce("formatVersion", F.lit(-1)).alias("format_version"), F.size("photos").cast("long").alias("photos"), first.alias("first_path"))


@query("s4_read_tasks", f"SELECT project_id, photos, project_id % 3 <> 1 AS resumable FROM ({_PROJECTS})")
def _(t):
    key = F.col("s_suppkey").cast("string")
    docs = _project_photos(t, key.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("/in/"), key).alias("sourcePath"), F.sha2("s_name", 256).alias("sourceSHA256"))
    tasks = docs.select(F.lit(1).alias("formatVersion"), F.col("project").cast("string").alias("jobID"), "photos", F.col("photos").alias("allPhotos"), F.create_map(F.lit("weights"), F.lit("/w")).alias("runtime"),
                        F.struct(F.lit(10.5).alias("memoryGiB"), F.lit(518).alias("modelSize")).alias("parameters"))
    # What is expected differs in the job's id, and for some in the model size, which forbids to resume.
    other = tasks.withColumn("parameters", F.struct(F.lit(10.5).alias("memoryGiB"), F.when(F.col("jobID").cast("long") % 3 == 1, 392).otherwise(518).alias("modelSize"))).withColumn("jobID", F.concat(F.lit("x"), "jobID"))
    expected = readers.read_tasks(t.spark, _documents(t, other, "jobID"))
    return readers.read_tasks(t.spark, _documents(t, tasks, "jobID"), expected).select(F.col("jobID").cast("long").alias("project_id"), F.size("photos").cast("long").alias("photos"), "resumable")


@query("s5_read_views", "SELECT scene_id, (row_number() OVER (PARTITION BY scene_id ORDER BY view_id) - 1)::INT AS position, view_id, w AS working_width, round(k[1], 3) + 0.0 AS focal FROM cameras")
def _(t):
    record = F.struct(F.concat_ws("/", "scene_id", "view_id").alias("id"), F.col("w").alias("workingWidth"), F.col("k").alias("encodedToWorkingPixels"))
    docs = t.cameras.groupBy(F.col("scene_id").alias("scene")).agg(F.sort_array(F.collect_list(record)).alias("records")).select("scene", F.lit(2).alias("formatVersion"), "records")
    back, part = readers.read_views(t.spark, _documents(t, docs, "scene")), F.split("id", "/")
    return back.select(part[0].cast("long").alias("scene_id"), F.col("view_id").alias("position"), part[1].cast("int").alias("view_id"), F.col("workingWidth").alias("working_width"),
                       (F.round(F.col("encodedToWorkingPixels")[0], 3) + F.lit(0.0)).alias("focal"))


@query("k1_write_new", "SELECT scene_id, fid, v0, true AS refused FROM faces")
def _(t):
    """A second write to the same path is refused and leaves the first as it was."""
    path, refused = _folder(t), False
    sinks.write_new(t.faces, path)
    try:
        sinks.write_new(t.faces.limit(0), path)
    except AnalysisException:
        refused = True
    return t.spark.read.schema(t.faces.schema).parquet(path).select("scene_id", "fid", "v0", F.lit(refused).alias("refused"))


@query("k3_mesh_round_trip", "SELECT f.scene_id, f.fid, f.v0, f.v1, f.v2, f.completion, v.z FROM faces f JOIN vertices v ON f.scene_id*1000+f.v0 = v.scene_id*1000+v.vid")
def _(t):
    path = _folder(t)
    sinks.write_mesh(t.vertices, t.faces, path)
    vertices, faces = readers.read_mesh(t.spark, path)
    return faces.join(vertices.select("scene_id", F.col("vid").alias("v0"), "z"), ["scene_id", "v0"])


@query("s8_face_order_check", "SELECT scene_id, fid FROM faces WHERE fid % 9 = 4")
def _(t):
    turned = t.faces.withColumn("v1", F.when(F.col("fid") % 9 == 4, F.col("v2")).otherwise(F.col("v1")))
    return readers.face_order_mismatches(t.faces, turned)


@query("s7_grid_round_trip", "SELECT scene_id, view_id, x, y, round(depth::FLOAT::DOUBLE, 3) + 0.0 AS depth, round(confidence, 3) + 0.0 AS confidence, mask FROM pixels")
def _(t):
    """Whole photos as arrays, in row order; a photo has as many entries as pixels, missing ones null."""
    path = _folder(t)
    cell = F.struct((F.col("y") * 40 + F.col("x")).alias("pos"), "depth", "confidence", "mask")
    grid = t.pixels.groupBy("scene_id", "view_id").agg(F.map_from_entries(F.collect_list(F.struct(cell["pos"], cell))).alias("p"))
    pick = lambda f, kind: F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda n: F.try_element_at("p", n)[f].cast(kind))
    sinks.write_new(grid.select("scene_id", "view_id", F.lit(40).alias("width"), pick("depth", "float").alias("depth"), pick("confidence", "float").alias("confidence"), pick("mask", "boolean").alias("mask")), path)
    back = readers.read_grids(t.spark, path)
    return back.where("mask IS NOT NULL").select("scene_id", "view_id", "x", "y", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("depth", "confidence")], "mask")


@query("s10_sample_round_trip", "SELECT job_id, stage, seconds, rss_bytes, coalesce(driver_bytes, -1) AS driver_bytes FROM job_samples")
def _(t):
    path = _folder(t)
    t.job_samples.select("job_id", "stage", "seconds", F.col("rss_bytes").alias("rssBytes"), F.col("driver_bytes").alias("mpsDriverBytes")).write.json(path)
    return readers.read_samples(t.spark, path).na.fill(-1, ["driver_bytes"])


@query("k4_report_round_trip", f"WITH {CLASSIFIED} SELECT kind, count(*) AS issues FROM classified WHERE kind IS NOT NULL GROUP BY kind")
def _(t):
    path = _folder(t)
    sinks.write_report(I.issue_counts(_classified(t)), path)
    return t.spark.read.schema("kind string, issues bigint").json(path)


@query("k2_publish_run", "SELECT project_id, run_id, quality FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) = 1")
def _(t):
    path = _folder(t)
    for part in (0, 1):
        sinks.publish_run({"photos": t.photos}, t.runs.where(F.col("run_id") % 2 == part), path, f"run-{part}")
    return sinks.read_current(t.spark, path).select("project_id", "run_id", "quality")


@query("s6_match_round_trip", "SELECT view_a, view_b, scene_id*2000+match_id AS key, round(xb, 4) + 0.0 AS xb FROM matches")
def _(t):
    path = _folder(t)
    m = t.matches.withColumn("key", F.col("scene_id") * 2000 + F.col("match_id"))
    point = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    # The first coordinate of the source point carries the key through the file.
    pairs = m.select(F.struct(F.array(*(F.concat(F.lit("p"), F.col(v).cast("string")) for v in ("view_a", "view_b"))).alias("names"), F.array(F.array(F.col("key").cast("double"), F.col("ya"))).alias("pointsA"),
                              F.array(point("xb", "yb")).alias("pointsB")).alias("p"))
    pairs.groupBy(F.spark_partition_id()).agg(F.collect_list("p").alias("pairs")).select("pairs").write.option("maxRecordsPerFile", 1).json(path)
    views = t.cameras.select(F.concat(F.lit("p"), F.col("view_id").cast("string")).alias("name"), "view_id").distinct()
    back = readers.read_matches(t.spark, path, views)
    return back.select("view_a", "view_b", F.col("xa").cast("bigint").alias("key"), (F.round("xb", 4) + F.lit(0.0)).alias("xb"))
