"""Silhouettes, instance choice, mask algebra and mask audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as K
from . import grids as R
from .gather import CELL
from .ranking import exact_quantiles, exact_quantiles_of
from .raster import splat


def compare_masks(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ("scene_id", "view_id"), union_floor: int = 1) -> DataFrame:
    """Intersection over union, extra (only a) and missing (only b) pixels of two masks."""
    both = a.select(*CELL, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*CELL, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    cells = both.groupBy(*CELL).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    out = cells.groupBy(*by).agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("common"), F.count("*").alias("_union"),
                                 F.count_if(F.col("_b") == 0).alias("extra"), F.count_if(F.col("_a") == 0).alias("missing"))
    return out.withColumn("iou", F.col("common") / F.greatest("_union", F.lit(max(union_floor, 1)))).drop("_union")


def splat_silhouette(seen: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pixels hit by projected points, closed by a 3x3 box."""
    return R.close(splat(seen, []).select(*CELL), cameras, R.box, 1)


def leave_one_out(seen: DataFrame, masks: DataFrame, cameras: DataFrame, source: str = "source_view") -> tuple[DataFrame, DataFrame]:
    """IoU of every view against the points of the other views, and the mean over the views of each scene."""
    per_view = compare_masks(splat_silhouette(seen.where(F.col(source) != F.col("view_id")), cameras), masks)
    return per_view, per_view.groupBy("scene_id").agg(F.avg("iou").alias("mean_iou"))


def pick_instance(labels: DataFrame, w: int, h: int) -> DataFrame:
    """Label with the largest centre-weighted area per view (lowest label on ties); label 0 is background."""
    nx, ny = (F.col("x") + 0.5) / w - 0.5, (F.col("y") + 0.5) / h - 0.5
    scores = labels.where("label > 0").groupBy("scene_id", "view_id", "label").agg(
        F.sum(F.exp(-(nx * nx + ny * ny) / 0.08)).alias("score"), F.count("*").alias("pixels"))
    best = scores.groupBy("scene_id", "view_id").agg(
        F.max(F.struct("score", (-F.col("label")).alias("_n"), "pixels")).alias("_m"), F.count("*").alias("candidates"))
    return best.select("scene_id", "view_id", (-F.col("_m._n")).alias("label"), F.col("_m.score").alias("score"),
                       F.col("_m.pixels").alias("pixels"), "candidates")


def pick_instance_strip(labels: DataFrame, w: int, h: int) -> DataFrame:
    """Most frequent label in the central strip (40-60 % of the width, 25-85 % of the height)."""
    strip = labels.where("label > 0").where(F.col("x").between(int(w * 0.40), int(w * 0.60) - 1)
                                            & F.col("y").between(int(h * 0.25), int(h * 0.85) - 1))
    counts = strip.groupBy("scene_id", "view_id", "label").agg(F.count("*").alias("pixels"))
    best = counts.groupBy("scene_id", "view_id").agg(F.max(F.struct("pixels", (-F.col("label")).alias("_n"))).alias("_m"))
    return best.select("scene_id", "view_id", (-F.col("_m._n")).alias("label"), F.col("_m.pixels").alias("pixels"))


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL).distinct(), CELL, "left_semi")


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).join(b.select(*CELL).distinct(), CELL, "left_anti")


def mask_min(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixelwise minimum of two grey masks (level); a pixel missing on one side counts as 0."""
    both = a.select(*CELL, "level", F.lit(1).alias("_s")).unionByName(b.select(*CELL, "level", F.lit(2).alias("_s")))
    return both.groupBy(*CELL).agg(F.min("level").alias("_l"), F.count_distinct("_s").alias("_n")) \
        .select(*CELL, F.when(F.col("_n") == 2, F.col("_l")).otherwise(0).alias("level"))


def sky_pixels(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blue background pixels inside the annotated box of their view (one box per view)."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return pixels.join(boxes.select("scene_id", "view_id", "x0", "y0", "x1", "y1"), ["scene_id", "view_id"]) \
        .where(inside & K.sky(F.col("r"), F.col("g"), F.col("b"))).select(*CELL).distinct()


def revise_masks(levels: DataFrame, pixels: DataFrame, frames: DataFrame, notes: DataFrame, work: tuple[int, int] = (1200, 1600)) -> dict[str, DataFrame]:
    """Take annotated background out of grey masks; returns the revised ``levels``, the ``sky`` pixels and the ``report``.

    ``levels``: scene_id, view_id, x, y, level (a missing pixel is 0); ``pixels``: r, g, b; ``frames``: w, h per photo;
    ``notes``: one row per photo as ``read_annotations`` gives it, in pixels of a ``work`` sized photo. In this order:
    polygons, widened by an elliptic kernel, become 0; below the start row, and on it, every level becomes the least under an
    elliptic kernel; blue sky pixels of the photo's box, widened by a square inside the box, become 0.
    """
    keys = ["scene_id", "view_id"]
    sx, sy = F.col("w") / work[0], F.col("h") / work[1]
    pixel = lambda v, s: (v + 0.5) * s - 0.5
    known = frames.join(notes, keys).withColumns({
        "gap": F.rint(F.col("exclusion_margin") * sy).cast("int"), "inset": F.rint(F.col("boundary_margin") * sy).cast("int"), "low": F.rint(F.col("boundary_start") * sy).cast("int"),
        "sky_box": F.transform("sky_box", lambda v: F.rint(pixel(v, sy)).cast("int"))})
    polygons = known.select(*keys, F.posexplode("polygons").alias("polygon_id", "p"), "w", "h").select(
        *keys, "polygon_id", F.transform("p", lambda q: F.struct(pixel(q["x"], sx).alias("x"), pixel(q["y"], sy).alias("y"))).alias("points"))
    gone = R.dilate(R.polygon_cells(polygons, frames), known, R.ellipse, F.col("gap"))
    left = levels.select(*CELL, "level").join(gone, CELL, "left_anti")
    inner = R.morph(left, known, ("shrink",), R.ellipse, F.col("inset")).withColumnRenamed("level", "_inner")
    start = known.select(*keys, "low")
    left = left.join(start, keys).join(inner, CELL, "left").select(
        *CELL, F.when(F.col("y") >= F.col("low"), F.coalesce("_inner", F.lit(0))).otherwise(F.col("level")).cast("int").alias("level"))
    boxed = known.where("sky_box IS NOT NULL").select(*keys, *[F.col("sky_box")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], "blue_red", "blue_green", "blue_least", "sky_margin", "w", "h")
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    blue = (F.col("b") > F.col("blue_red") * F.col("r")) & (F.col("b") > F.col("blue_green") * F.col("g")) & (F.col("b") - F.col("r") > F.col("blue_least"))
    sky = pixels.join(boxed.drop("w", "h"), keys).where(inside & blue).select(*CELL)
    sky = R.dilate(sky, boxed, R.box, F.col("sky_margin")).join(boxed.select(*keys, "x0", "y0", "x1", "y1"), keys).where(inside).select(*CELL)
    # Sky pixels count where the mask was certain until then.
    removed = left.where("level >= 254").join(sky, CELL, "left_semi")
    revised = left.where("level > 0").join(sky, CELL, "left_anti")
    report = mask_revision_report(levels, revised, removed, polygons)
    return {"levels": revised, "sky": removed, "report": report}


def mask_revision_report(before: DataFrame, after: DataFrame, sky: DataFrame | None = None, polygons: DataFrame | None = None) -> DataFrame:
    """Certain pixels (level at least 254) before, after and removed per view; sky pixels removed; polygon count."""
    parts = [before.where("level >= 254").select(*CELL, F.lit(1).alias("_b"), F.lit(0).alias("_a"), F.lit(0).alias("_s")),
             after.where("level >= 254").select(*CELL, F.lit(0).alias("_b"), F.lit(1).alias("_a"), F.lit(0).alias("_s"))]
    if sky is not None:
        parts.append(sky.select(*CELL, F.lit(0).alias("_b"), F.lit(0).alias("_a"), F.lit(1).alias("_s")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    cells = stacked.groupBy(*CELL).agg(*[F.max(n).alias(n) for n in ("_b", "_a", "_s")])
    out = cells.groupBy("scene_id", "view_id").agg(
        F.sum("_b").alias("before"), F.sum("_a").alias("after"), F.count_if((F.col("_b") == 1) & (F.col("_a") == 0)).alias("removed"),
        F.count_if((F.col("_s") == 1) & (F.col("_b") == 1)).alias("sky_removed"))
    if polygons is not None:
        counts = polygons.groupBy("scene_id", "view_id").agg(F.count("*").alias("polygons"))
        out = out.join(counts, ["scene_id", "view_id"], "left").na.fill(0, ["polygons"])
    return out


def mask_audit(mask: DataFrame, w: Column, h: Column, band: int = 32, crop: int = 384) -> DataFrame:
    """Bounding box, anchor points and three crop boxes of every mask.

    Anchors: median x of the top and bottom ``band`` rows, and the rightmost pixel of the upper 65 % with the median y
    of the ``band``/2 columns left of it. Medians truncate to whole pixels.
    """
    keys = ["scene_id", "view_id"]
    m = mask.select(*keys, "x", "y")
    box = m.groupBy(*keys).agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    near = m.join(box, keys)
    upper = F.col("y") < F.col("top") + (F.col("bottom") - F.col("top")) * 0.65
    rightmost = near.where(upper).groupBy(*keys).agg(F.max("x").alias("right_x"))
    near = near.join(rightmost, keys)
    mid = exact_quantiles_of(near, keys, {
        "top": (F.when(F.col("y") < F.col("top") + band, F.col("x")), {"top_x": 0.5}),
        "bottom": (F.when(F.col("y") > F.col("bottom") - band, F.col("x")), {"bottom_x": 0.5}),
        "side": (F.when(upper & (F.col("x") > F.col("right_x") - band // 2), F.col("y")), {"right_y": 0.5})})
    out = box.join(rightmost, keys).join(mid, keys)
    out = out.withColumns({c: F.col(c).cast("int") for c in ("top_x", "bottom_x", "right_y")})
    reach = band * 5 // 2
    anchors = {"a": (F.col("top_x"), F.col("top") + reach), "b": (F.col("right_x") - reach, F.col("right_y")),
               "c": (F.col("bottom_x"), F.col("bottom") - reach)}
    for n, (x, y) in anchors.items():
        out = out.withColumns({f"crop_{n}_x": F.least(F.greatest(x - crop // 2, F.lit(0)), w - crop),
                               f"crop_{n}_y": F.least(F.greatest(y - crop // 2, F.lit(0)), h - crop)})
    return out


def confidence_cut(pixels: DataFrame, quantile: float = 0.1) -> DataFrame:
    """Foreground pixels whose confidence reaches the per-view quantile; adds ``threshold``."""
    valid = pixels.where(F.col("mask") & (F.col("depth") > 0))
    cut = exact_quantiles(valid, ["scene_id", "view_id"], "confidence", {"threshold": quantile})
    return valid.join(cut, ["scene_id", "view_id"]).where(F.col("confidence") >= F.col("threshold"))


def grid_faces(pixels: DataFrame, jump: float = 0.04) -> DataFrame:
    """Two triangles per 2x2 block of valid pixels, dropped where the depth range reaches jump x median depth.

    Each pixel is sent to the four blocks it touches; one pre-aggregated group per block replaces three self joins.
    """
    keys = ["scene_id", "view_id"]
    med = exact_quantiles(pixels, keys, "depth", {"_med": 0.5})
    spots = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for n, (dx, dy) in {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}.items()])
    block = pixels.select(*keys, "x", "y", "depth", F.explode(spots).alias("_o")).groupBy(
        *keys, (F.col("x") - F.col("_o.dx")).alias("x"), (F.col("y") - F.col("_o.dy")).alias("y")).agg(
        *[F.max(F.when(F.col("_o.n") == n, F.col("depth"))).alias(f"_{n}") for n in "abcd"])
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.array(*[F.col(f"_{n}") for n in tri]).alias("z"))
                      for i, tri in enumerate(("acb", "bcd"))])
    tri = block.select(*keys, "x", "y", F.explode(sides).alias("_t")).select(*keys, "x", "y", "_t.*") \
        .where(F.forall("z", lambda v: v.isNotNull()))
    return tri.join(med, keys).where(F.array_max("z") - F.array_min("z") < F.col("_med") * jump) \
        .select(*keys, "x", "y", "side", F.array_max("z").alias("far"), F.array_min("z").alias("near"))
