"""File, manifest, task, view, match, grid, mesh, event, sample and annotation readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import decoded_type, digest
from ..operators.jobs import parse_events
from . import schemas as S


def scan_files(spark: SparkSession, selections: list[str]) -> DataFrame:
    """Direct entries of every selected file or folder, ordered by (selection, name); nested folders are not entered.

    ``arrival`` is the sort key itself, so no global numbering pass is needed to order files.
    """
    out = None
    for position, path in enumerate(selections):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
        name = F.element_at(F.split("path", "/"), -1)
        one = one.select(F.struct(F.lit(position).alias("selection"), name.alias("name")).alias("arrival"), "path", name.alias("name"),
                         F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("").alias("suffix"), "length", "content")
        out = one if out is None else out.unionByName(one)
    return out


def inventory_files(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Name, decoded type, size and digest of every decodable file; camera columns join in by path when given."""
    out = files.withColumn("decoded_type", decoded_type(F.col("content"), F.col("suffix"))).where("decoded_type IS NOT NULL") \
        .select("path", "name", "decoded_type", F.col("length").alias("byte_count"), digest(F.col("content")).alias("content_sha256"))
    return out if metadata is None else out.join(metadata, "path", "left")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Project manifests of versions 1-3 in the current form; ``status`` tells why any other document was rejected.

    Missing optional metadata stays null and the stored version is kept next to the current one.
    """
    raw = spark.read.schema(S.MANIFEST).option("multiLine", "true").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("path", F.input_file_name())
    known = F.coalesce(F.col("formatVersion").isin(1, 2, 3), F.lit(False))
    status = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(~known, "unsupported-version").otherwise("ok")
    return raw.withColumns({"status": status, "stored_version": F.col("formatVersion")}).withColumn(
        "formatVersion", F.when(F.col("status") == "ok", 3)).drop("_corrupt")


def read_tasks(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Task requests; with ``expected`` (same columns) ``resumable`` tells whether everything but the job id is equal."""
    tasks = spark.read.schema(S.TASK).option("multiLine", "true").json(path)
    if expected is None:
        return tasks
    body = ["formatVersion", "photos", "allPhotos", "photoUse", "runtime", "parameters"]
    text = F.to_json(F.struct(*[F.map_entries("runtime").alias("runtime") if c == "runtime" else F.col(c) for c in body]), {"ignoreNullFields": "false"})
    want = expected.select(text.alias("_t")).distinct().withColumn("_ok", F.lit(True))
    return tasks.withColumn("_t", text).join(want, "_t", "left").withColumn(
        "resumable", F.col("_ok").isNotNull() & (F.col("jobID") != "")).drop("_t", "_ok")


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """One row per photo of a dataset document."""
    return spark.read.schema(S.DATASET).option("multiLine", "true").json(path) \
        .select("formatVersion", F.posexplode("records").alias("view_id", "r")).select("formatVersion", "view_id", "r.*")


def read_matches(spark: SparkSession, path: str, views: DataFrame) -> DataFrame:
    """One row per correspondence; empty pairs and pairs with unknown photo names are dropped. ``views``: name, view_id."""
    p = spark.read.schema(S.MATCH_SET).option("multiLine", "true").json(path).select(F.explode("pairs").alias("p"))
    rows = p.select(F.col("p.names")[0].alias("name_a"), F.col("p.names")[1].alias("name_b"),
                    F.posexplode(F.arrays_zip(F.col("p.pointsA").alias("a"), F.col("p.pointsB").alias("b"))).alias("match_id", "m"))
    for side in "ab":
        rows = rows.join(views.select(F.col("name").alias(f"name_{side}"), F.col("view_id").alias(f"view_{side}")), f"name_{side}")
    return rows.select("view_a", "view_b", "match_id", F.col("m.a")[0].alias("xa"), F.col("m.a")[1].alias("ya"),
                       F.col("m.b")[0].alias("xb"), F.col("m.b")[1].alias("yb"))


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Per-view arrays to pixel rows."""
    return spark.read.schema(S.GRID).parquet(path).select(
        "scene_id", "view_id", "width", F.posexplode(F.arrays_zip("depth", "confidence", "mask")).alias("pos", "p")).select(
        "scene_id", "view_id", (F.col("pos") % F.col("width")).alias("x"), F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"),
        F.col("p.depth").cast("double").alias("depth"), F.col("p.confidence").cast("double").alias("confidence"), F.col("p.mask").alias("mask"))


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of a mesh folder."""
    return (spark.read.schema(S.VERTEX).parquet(f"{path}/vertices"), spark.read.schema(S.FACE).parquet(f"{path}/faces"))


def face_order_mismatches(faces: DataFrame, other: DataFrame) -> DataFrame:
    """Faces whose corners differ between two meshes, or that exist on one side only."""
    b = other.select("scene_id", "fid", F.struct("v0", "v1", "v2").alias("_b"))
    a = faces.select("scene_id", "fid", F.struct("v0", "v1", "v2").alias("_a"))
    return a.join(b, ["scene_id", "fid"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("scene_id", "fid")


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of event logs; a line that is no protocol-1 event becomes a diagnostic row, never an error."""
    rows = parse_events(spark.read.text(path))
    return rows.where("diagnostic IS NULL").drop("diagnostic"), rows.where("diagnostic IS NOT NULL").select("diagnostic")


def stream_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


def read_samples(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Resource samples, batch or stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(S.SAMPLE).json(path).select("job_id", "stage", "seconds", F.col("rssBytes").alias("rss_bytes"), F.col("mpsDriverBytes").alias("driver_bytes"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Boxes and polygons of an annotation document, one row each, in document order."""
    return spark.read.schema(S.REGIONS).option("multiLine", "true").json(path).select(F.posexplode("regions").alias("region_order", "r")).select(
        "region_order", F.col("r.id").alias("region_id"), F.col("r.photo").alias("photo"), *[F.col("r.box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.transform("r.polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("polygon"))


def _notes(spark: SparkSession, path: str, photos: DataFrame) -> DataFrame:
    """Every photo (scene_id, view_id, name) beside the annotation document of its scene; documents lie in folders scene_id=<n>."""
    schema = T.StructType([*S.REGIONS.fields, T.StructField("scene_id", T.LongType())])
    return photos.select("scene_id", "view_id", "name").join(spark.read.schema(schema).option("multiLine", "true").json(path), "scene_id")


def read_margins(spark: SparkSession, path: str, photos: DataFrame) -> DataFrame:
    """Lower-boundary margin per photo: the photo's own value, else its document's default."""
    own = F.try_element_at("perPhotoLowerBoundaryMarginWorkingPixels", F.col("name"))
    return _notes(spark, path, photos).select("scene_id", "view_id", "name", F.coalesce(own, "lowerBoundaryMarginWorkingPixels").alias("margin"))


def read_annotations(spark: SparkSession, path: str, photos: DataFrame) -> DataFrame:
    """Background polygons, margins, start row and sky rule of every photo, in working pixels, as ``revise_masks`` takes them.

    A photo without polygons has none; one without a sky box has a null box; missing margins are 0.
    """
    sky, none = F.col("instrumentSkyExclusion"), F.lit(0.0)
    points = F.transform(F.try_element_at("backgroundPolygons", F.col("name")), lambda p: F.transform(p, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))
    own = F.try_element_at("perPhotoLowerBoundaryMarginWorkingPixels", F.col("name"))
    return _notes(spark, path, photos).select(
        "scene_id", "view_id", F.coalesce(points, F.array().cast("array<array<struct<x:double,y:double>>>")).alias("polygons"),
        F.coalesce("manualExclusionMarginWorkingPixels", none).alias("exclusion_margin"), F.coalesce(own, "lowerBoundaryMarginWorkingPixels", none).alias("boundary_margin"),
        F.coalesce("lowerBoundaryMarginStartsAtWorkingY", none).alias("boundary_start"), F.try_element_at(sky["boxes"], F.col("name")).alias("sky_box"),
        sky["blueRedRatio"].alias("blue_red"), sky["blueGreenRatio"].alias("blue_green"), sky["minimumBlueMinusRed"].alias("blue_least"), sky["fullPixelMargin"].alias("sky_margin"))
