"""Rasterisation, splats and visibility as grouped minimums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import matrices as M
from .gather import flat_cameras, once, pictures, sample_nearest_clamped

KEYS = ["scene_id", "view_id"]
#: Side of a square of the atlas that a task paints at once, and the pixels of triangles' boxes that it tests at once.
SQUARE, TESTED = 64, 1 << 18
#: What a face's texels carry to become surface points.
SIDES = ["sided", *[f"{a}{i}" for i in range(3) for a in "xyz"]]


def _boxed(triangles: DataFrame, keys: list[str], w: Column, h: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Triangles in front of the camera that have an area and a box _xlo.._xhi, _ylo.._yhi inside w x h, with _den, twice that area."""
    c = F.col
    den = (c("py1") - c("py2")) * (c("px0") - c("px2")) + (c("px2") - c("px1")) * (c("py0") - c("py2"))
    good = triangles.where((c("pz0") > 0) & (c("pz1") > 0) & (c("pz2") > 0)).withColumn("_den", den).where(F.abs("_den") >= 1e-10)
    box = {}
    for a, size in (("x", w), ("y", h)):
        ends = [c(f"p{a}{i}") for i in range(3)]
        box[f"_{a}lo"] = F.greatest(F.ceil(F.least(*ends)), F.lit(0)).cast("int")
        box[f"_{a}hi"] = F.least(F.floor(F.greatest(*ends)), size - 1).cast("int")
    corner = [f"p{a}{i}" for i in range(3) for a in "xyz"]
    return good.select(*keys, "fid", "_den", *corner, *carry, once(**box)).where("_xlo <= _xhi AND _ylo <= _yhi")


def rasterize(triangles: DataFrame, keys: list[str], w: Column, h: Column) -> DataFrame:
    """Nearest face per pixel: (keys, x, y, z, fid, b0, b1).

    Input corners px0, py0, pz0 ... px2, py2, pz2 in pixels and depth. A pixel belongs to a triangle when its centre
    has all barycentrics at or above -1e-7; depth and barycentrics are perspective-correct; equal depths go to the
    lower face id. Triangles expand to rows, rows to pixels inside the box, and the minimum is pre-aggregated per pixel
    before the shuffle, so crowded pixels do not travel.
    """
    c = F.col
    corner = [f"p{a}{i}" for i in range(3) for a in "xyz"]
    boxed = _boxed(triangles, keys, w, h).select(
        *keys, "fid", "_den", *corner, "_xlo", "_xhi", F.explode(F.sequence("_ylo", "_yhi")).alias("y")) \
        .select(*keys, "fid", "_den", *corner, "y", F.explode(F.sequence("_xlo", "_xhi")).alias("x"))
    u = ((c("py1") - c("py2")) * (c("x") - c("px2")) + (c("px2") - c("px1")) * (c("y") - c("py2"))) / c("_den")
    v = ((c("py2") - c("py0")) * (c("x") - c("px2")) + (c("px0") - c("px2")) * (c("y") - c("py2"))) / c("_den")
    hit = boxed.select(*keys, "fid", "pz0", "pz1", "pz2", "x", "y", once(_u=u, _v=v)) \
        .where((c("_u") >= -1e-7) & (c("_v") >= -1e-7) & (1.0 - c("_u") - c("_v") >= -1e-7))
    inv = c("_u") / c("pz0") + c("_v") / c("pz1") + (1.0 - c("_u") - c("_v")) / c("pz2")
    hit = hit.withColumn("_inv", inv)
    best = hit.groupBy(*keys, "x", "y").agg(F.min(F.struct(
        (1.0 / c("_inv")).alias("z"), "fid", (c("_u") / c("pz0") / c("_inv")).alias("b0"),
        (c("_v") / c("pz1") / c("_inv")).alias("b1"))).alias("_m"))
    return best.select(*keys, "x", "y", "_m.*")


def project_corners(corners: DataFrame, cameras: DataFrame, want: str | None = None) -> DataFrame:
    """Triangles of every view: corner columns x0.. become px0, py0, pz0 .. . With ``want``, a column, a triangle meets that view only."""
    cams, ext, k = flat_cameras(cameras, ("w", "h"))
    out = corners.join(cams, "scene_id") if want is None else corners.join(cams.withColumn(want, F.col("view_id")), ["scene_id", want])
    cols = {}
    for i in range(3):
        p = M.project(F.col(f"x{i}"), F.col(f"y{i}"), F.col(f"z{i}"), ext, k)
        cols |= {f"px{i}": p["u"], f"py{i}": p["v"], f"pz{i}": p["z"]}
    return out.select("scene_id", "view_id", "fid", "w", "h", once(**cols))


def view_zbuffer(corners: DataFrame, cameras: DataFrame) -> DataFrame:
    """Nearest face per pixel of every view."""
    return rasterize(project_corners(corners, cameras), KEYS, F.col("w"), F.col("h"))


def _pixels(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and x, y of every pixel of the boxes x0..x1, y0..y1."""
    wide, area = x1 - x0 + 1, (x1 - x0 + 1) * (y1 - y0 + 1)
    row = np.repeat(np.arange(len(area)), area)
    place = np.arange(len(row)) - np.repeat(np.cumsum(area) - area, area)
    return row, x0[row] + place % wide[row], y0[row] + place // wide[row]


def _square_painter(keys: list[str], carry: tuple[str, ...], schema: pa.Schema):
    """The triangles of one square of the atlas as its texels: the rule of ``rasterize`` at depth 1, a run of boxes at a time."""
    def paint(found: pa.Table) -> pa.Table:
        col = lambda n: found[n].to_numpy()
        (x0, x1), (y0, y1) = ((np.maximum(col(f"_{a}lo"), at * SQUARE), np.minimum(col(f"_{a}hi"), at * SQUARE + SQUARE - 1)) for a, at in (("x", found["_tx"][0].as_py()), ("y", found["_ty"][0].as_py())))
        px, py, den = [col(f"px{i}") for i in range(3)], [col(f"py{i}") for i in range(3)], col("_den")
        known, fid = found["fid"].is_valid().to_numpy(), found["fid"].fill_null(0).to_numpy()
        held = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, *[np.float64] * 3))
        run = np.cumsum((x1 - x0 + 1) * (y1 - y0 + 1)) // TESTED
        for first, last in zip(np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), [*np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]):
            part = slice(first, last)
            row, x, y = _pixels(x0[part], x1[part], y0[part], y1[part])
            row += first
            u = ((py[1] - py[2])[row] * (x - px[2][row]) + (px[2] - px[1])[row] * (y - py[2][row])) / den[row]
            v = ((py[2] - py[0])[row] * (x - px[2][row]) + (px[0] - px[2])[row] * (y - py[2][row])) / den[row]
            rest = 1.0 - u - v
            hit = ~((u < -1e-7) | (v < -1e-7) | (rest < -1e-7))
            row, x, y, u, v, rest = (a[hit] for a in (row, x, y, u, v, rest))
            inv = u + v + rest
            held = [np.concatenate(both) for both in zip(held, (row, x, y, 1.0 / inv, u / inv, v / inv))]
            row, x, y, z, b0, b1 = held
            order = np.lexsort((b1, b0, fid[row], known[row], z, x, y))
            first_of = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)][:len(order)]
            held = tuple(a[order[first_of]] for a in held)
        row, x, y, z, b0, b1 = held
        out = {**{k: found[k].take(row) for k in (*keys, "fid", *carry)}, "x": x.astype(np.int32), "y": y.astype(np.int32), "z": z, "b0": b0, "b1": b1}
        return pa.Table.from_arrays([out[f.name].combine_chunks().cast(f.type) if isinstance(out[f.name], pa.ChunkedArray) else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return paint


def atlas_raster(uv: DataFrame, width: int, height: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Face and barycentrics of every atlas texel (texel centre, v axis up), and the columns ``carry`` of its face's row.

    A face goes to the squares of the atlas that its box meets, and a task paints one square: faces are shuffled, not their texels.
    """
    cols = {}
    for i, n in enumerate("abc"):
        cols[f"px{i}"] = F.col(f"u{n}") * width - 0.5
        cols[f"py{i}"] = (1.0 - F.col(f"v{n}")) * height - 0.5
        cols[f"pz{i}"] = F.lit(1.0)
    boxed = _boxed(uv.select("scene_id", "fid", *carry, *[v.cast("double").alias(k) for k, v in cols.items()]), ["scene_id"], F.lit(width), F.lit(height), carry)
    for a in "xy":
        boxed = boxed.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(F.col(f"_{a}lo") / SQUARE).cast("int"), F.floor(F.col(f"_{a}hi") / SQUARE).cast("int"))))
    kind = uv.schema
    schema = StructType([StructField("scene_id", kind["scene_id"].dataType), *[StructField(n, IntegerType()) for n in "xy"], StructField("z", DoubleType()),
                         StructField("fid", kind["fid"].dataType), *[StructField(n, DoubleType()) for n in ("b0", "b1")], *[StructField(n, kind[n].dataType) for n in carry]])
    return boxed.drop("pz0", "pz1", "pz2").groupBy("scene_id", "_tx", "_ty").applyInArrow(_square_painter(["scene_id"], carry, to_arrow_schema(schema)), schema)


def with_sides(uv: DataFrame, corners: DataFrame) -> DataFrame:
    """Faces of the atlas with their corners, for texels that carry them (``SIDES``)."""
    side = corners.select("scene_id", "fid", F.lit(True).alias("sided"), *[F.col(c).cast("double").alias(c) for c in SIDES[1:]])
    return uv.drop(*SIDES).join(side.hint("merge"), ["scene_id", "fid"], "left")


def surface_points(texels: DataFrame, corners: DataFrame | None = None) -> DataFrame:
    """World position of barycentric points; the third weight is 1 - b0 - b1. Without ``corners`` texels carry ``SIDES``; those of a face that has none are left out."""
    b2 = 1.0 - (F.col("b0") + F.col("b1"))
    xyz = {a: F.col("b0") * F.col(f"{a}0") + F.col("b1") * F.col(f"{a}1") + b2 * F.col(f"{a}2") for a in "xyz"}
    texels = texels.withColumnsRenamed({"x": "tx", "y": "ty", "z": "tz"})
    if corners is None:
        return texels.where("sided").withColumns(xyz).drop(*SIDES)
    side = corners.select("scene_id", "fid", *SIDES[1:])
    return texels.join(side.hint("merge"), ["scene_id", "fid"]).withColumns(xyz).drop(*SIDES[1:])


def visibility_pictures(frames: DataFrame, zbuffer: DataFrame, mask_distance: DataFrame, more: tuple[str, ...] = (), pixels: DataFrame | None = None,
                        extra: list[tuple[DataFrame, list[str]]] | None = None) -> DataFrame:
    """Photos that carry what ``visible`` samples: surface depth, mask distance and ``more`` columns of ``mask_distance``.

    With ``pixels`` they carry its r, g, b too; ``extra`` names further pixel tables and their columns.
    """
    colors = [] if pixels is None else [(pixels, ["r", "g", "b"])]
    return pictures(frames, [(zbuffer.withColumnRenamed("z", "_zb"), ["_zb"]), (mask_distance, ["distance", *more]), *colors, *(extra or [])])


def visible(points: DataFrame, zbuffer: DataFrame, mask_distance: DataFrame, tolerance: float = 0.0025,
            full_mask: DataFrame | None = None) -> DataFrame:
    """Add ``valid``, ``mask_distance`` and ``depth_gap`` to projected points (u, v, z_cam, ext/k free, fx, w, h).

    Valid = inside the texture frame, on the mask, and as deep as the nearest surface within tolerance + 1.5 z/fx.
    """
    w, h = F.col("w"), F.col("h")
    out = sample_nearest_clamped(points, zbuffer.withColumnRenamed("z", "_zb"), {"_zb": None}, w, h)
    out = sample_nearest_clamped(out, mask_distance, {"distance": 0.0}, w, h)
    gap = F.abs(F.col("z_cam") - F.col("s__zb"))
    ok = (M.in_texture_frame(F.col("u"), F.col("v"), F.col("z_cam"), w, h) & (F.col("s_distance") > 0)
          & (gap < tolerance + F.col("z_cam") / F.col("fx") * 1.5))
    if full_mask is not None:
        out = sample_nearest_clamped(out, full_mask, {"level": 0.0}, w, h)
        ok = ok & (F.col("s_level") >= 254)
    return out.withColumn("valid", F.coalesce(ok, F.lit(False))).withColumn("depth_gap", gap) \
        .withColumnRenamed("s_distance", "mask_distance").drop("s__zb", "s_level")


#: Projected points that a task reduces at once.
HELD = 500_000


def _front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every ``HELD`` points those that are nearest in their pixel; points with a null among their keys all go on."""
    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = ["scene_id", "view_id", "y", "x", "z", "point_id"]
        bare = np.zeros(table.num_rows, bool)
        for c in keys:
            bare |= table[c].is_null().to_numpy()
        at = np.flatnonzero(~bare)
        cols = [table[c].take(pa.array(at)).to_numpy() for c in keys]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.ones(len(at), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        front = new | ((cols[4] == cols[4][first]) & (cols[5] == cols[5][first]))
        keep = np.concatenate([np.flatnonzero(bare), at[order[front]]])
        yield from table.take(pa.array(keep)).combine_chunks().to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            yield from settle(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from settle(pa.Table.from_batches(held))


def splat(seen: DataFrame, payload: list[str]) -> DataFrame:
    """Nearest point per pixel of projected points (half-even pixel rounding, lower point id on ties).

    A minimum of structs is sorted, not hashed: tasks first drop what a nearer point of the same run hides, so that the sort
    holds little more than the pixels.
    """
    px, py = F.rint("u").cast("int"), F.rint("v").cast("int")
    inside = seen.where(F.col("z_cam") > 0).withColumns({"_px": px, "_py": py}).where(
        (F.col("_px") >= 0) & (F.col("_py") >= 0) & (F.col("_px") < F.col("w")) & (F.col("_py") < F.col("h")))
    rows = inside.select("scene_id", "view_id", F.col("_px").alias("x"), F.col("_py").alias("y"), F.col("z_cam").alias("z"), "point_id", *payload)
    best = rows.mapInArrow(_front, rows.schema).groupBy("scene_id", "view_id", "x", "y").agg(F.min(F.struct("z", "point_id", *payload)).alias("_m"))
    return best.select("scene_id", "view_id", "x", "y", "_m.*")


def region_faces(raster: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct faces seen inside each box [x0, x1) x [y0, y1) of its view.

    Boxes are split over their pixel rows and meet the raster on (scene, view, row), an equi join, before the column
    range is tested.
    """
    rows = regions.where("y0 < y1").select("scene_id", "view_id", "region_id", "x0", "x1",
                                           F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    return raster.join(rows, ["scene_id", "view_id", "y"]).where("x >= x0 AND x < x1") \
        .select("scene_id", "region_id", "fid").distinct()
