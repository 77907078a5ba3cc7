"""Point-camera joins and pixel gathers.

All tables are keyed by ``scene_id``; pixel tables also by ``view_id, x, y``. Joins are equi joins on those keys.

Where points meet photos of work size, the photos travel: ``pictures`` makes one row of a photo, ``in_views`` joins it with the
camera, and a gather is an array access. So a point is shuffled once, before it is multiplied by the views of its scene. Photos of
full size are cut into ``tiles``; a projected point is shuffled once to its tile, whatever the number of columns sampled there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import matrices as M

CELL = ["scene_id", "view_id", "x", "y"]


FLAT = [f"_e{i}" for i in range(12)] + [f"_k{i}" for i in range(9)]


def flat_cameras(cameras: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column], list[Column]]:
    """Camera table with one scalar column per matrix element, and those columns as two lists.

    Scalars keep the generated projection code small enough to compile; array reads would each carry a bounds check.
    """
    ext, k = [F.col("ext")[i].alias(f"_e{i}") for i in range(12)], [F.col("k")[i].alias(f"_k{i}") for i in range(9)]
    return (cameras.select("scene_id", "view_id", *keep, *ext, *k), [F.col(n) for n in FLAT[:12]],
            [F.col(n) for n in FLAT[12:]])


def once(**cols: Column) -> Column:
    """Generator that emits the named columns, evaluated once per row.

    Later filters and expressions read the emitted values instead of repeating the arithmetic, which keeps the
    generated code below the size that can be compiled.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))


#: A scene's points are dealt over so many join keys where they meet pictures; each picture is sent once per key.
PARTS = 4


#: Side of a tile in cells. A reader of a stored table holds some thousands of tiles at once: a tile of 16 x 16 cells keeps that small.
TILE = 16
#: Side of the block that a task cuts into tiles, in tiles.
BLOCK = 8


def _filled(cells: pa.Table, name: str, w: int, h: int, step: int) -> pa.Array:
    """Column ``name`` of the cells inside w x h, row by row of ``step`` places; of a position given twice the largest value stays."""
    x, y = (cells[c].fill_null(-1).to_numpy() for c in ("x", "y"))
    given = (x >= 0) & (x < w) & (y >= 0) & (y < h) & cells[name].is_valid().to_numpy()
    at, value = y[given].astype(np.int64) * step + x[given], cells[name].fill_null(0.0).to_numpy()[given]
    flat, found = np.zeros(step * (h + 1)), np.zeros(step * (h + 1), bool)
    order = np.argsort(value, kind="stable")
    flat[at[order]], found[at] = value[order], True
    return pa.array(flat, mask=~found)


def _painter(names: list[str], schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Cells of one photo, and its size, as one row with an array."""
    def paint(cells: pa.Table) -> pa.Table:
        frame = cells.filter(cells["p_w"].is_valid())
        if not frame.num_rows:
            return schema.empty_table()
        w, h = (max(frame[c].to_pylist()) for c in ("p_w", "p_h"))
        step = w + 1
        fields = [_filled(cells, n, w, h, step) for n in names]
        photo = pa.ListArray.from_arrays(pa.array([0, step * (h + 1)], pa.int32()), pa.StructArray.from_arrays(fields, names))
        return pa.Table.from_arrays([pa.array([cells[k][0].as_py()], schema.field(k).type) for k in ("scene_id", "view_id")] + [pa.array([step], pa.int32()), photo.cast(schema.field("p").type)], schema=schema)

    return paint


def pictures(frames: DataFrame, tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row per photo of ``frames`` (scene_id, view_id, w, h): its cells as a row-major array ``p`` of structs.

    ``tables`` are pixel tables with the columns to take from each; a missing pixel is null, of a position given twice the
    largest value stays. Each row of the array is ``p_step`` = w + 1 long and there is one more row, so that a cell's neighbours
    need no test. A task holds one photo at a time: meant for photos of work size.
    """
    names = [c for _, cols in tables for c in cols]
    none = lambda t: F.lit(None).cast(t)
    rows = frames.where("w > 0 AND h > 0").select("scene_id", "view_id", F.col("w").cast("int").alias("p_w"), F.col("h").cast("int").alias("p_h"),
                                                  none("int").alias("x"), none("int").alias("y"), *[none("double").alias(n) for n in names])
    for table, cols in tables:
        rows = rows.unionByName(table.select("scene_id", "view_id", none("int").alias("p_w"), none("int").alias("p_h"), F.col("x").cast("int").alias("x"),
                                             F.col("y").cast("int").alias("y"), *[(F.col(n) if n in cols else none("double")).cast("double").alias(n) for n in names]))
    keys = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("scene_id", "view_id"))
    ddl = f"{keys}, p_step int, p array<struct<{', '.join(f'{n}: double' for n in names)}>>"
    return rows.groupBy("scene_id", "view_id").applyInArrow(_painter(names, to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def _tiler(names: list[str], schema: pa.Schema, size: int) -> Callable[[pa.Table], pa.Table]:
    """Cells of one block of tiles, x and y counted from its corner, as one row per tile with an array per column."""
    def paint(cells: pa.Table) -> pa.Table:
        x, y = (cells[c].to_numpy().astype(np.int64) for c in "xy")
        # A cell also ends the tiles before it, where it is the first of its own.
        rows, place = [], []
        for dx in (0, 1):
            for dy in (0, 1):
                tx, ty = x // size - dx, y // size - dy
                row = np.flatnonzero(((x % size == 0) | (dx == 0)) & ((y % size == 0) | (dy == 0)) & (tx >= 0) & (ty >= 0) & (tx < BLOCK) & (ty < BLOCK))
                rows.append(row)
                place.append((ty * BLOCK + tx)[row] * (size + 1) ** 2 + (y - ty * size)[row] * (size + 1) + (x - tx * size)[row])
        row, at = np.concatenate(rows), np.concatenate(place)
        each, tile = np.unique(at // (size + 1) ** 2, return_inverse=True)
        at = tile * (size + 1) ** 2 + at % (size + 1) ** 2
        ends, out = pa.array(np.arange(len(each) + 1) * (size + 1) ** 2, pa.int32()), []
        for n in names:
            value, given = cells[n].fill_null(0.0).to_numpy()[row], cells[n].is_valid().to_numpy()[row]
            order = np.argsort(value[given], kind="stable")
            flat, found = np.zeros(len(each) * (size + 1) ** 2), np.zeros(len(each) * (size + 1) ** 2, bool)
            flat[at[given][order]], found[at[given]] = value[given][order], True
            out.append(pa.ListArray.from_arrays(ends, pa.array(flat, mask=~found)).cast(schema.field(f"p_{n}").type))
        keys = [pa.array([cells[k][0].as_py()] * len(each), schema.field(k).type) for k in schema.names[:2]]
        corner = [pa.array(cells[f"block_{a}"][0].as_py() * BLOCK + t, pa.int32()) for a, t in (("x", each % BLOCK), ("y", each // BLOCK))]
        return pa.Table.from_arrays([*keys, *corner, *out], schema=schema)

    return paint


def tiles(pixels: DataFrame, cols: list[str], size: int = TILE) -> DataFrame:
    """Photos of any size as squares of ``size`` cells: scene_id, view_id, tile_x, tile_y and a row-major array ``p_<col>`` of each column.

    A tile also has the row and the column that follow it, so a bilinear sample reads one tile. A task holds one block of ``BLOCK`` x
    ``BLOCK`` tiles at a time. A missing pixel is null, of a position given twice the largest value stays.
    """
    side = size * BLOCK
    spots = lambda a: F.explode(F.array_distinct(F.array(*[F.floor((F.col(a) - d) / side).cast("int") for d in (0, 1)])))
    rows = pixels.where("x IS NOT NULL AND y IS NOT NULL").select("scene_id", "view_id", "x", "y", *[F.col(c).cast("double").alias(c) for c in cols])
    rows = rows.withColumn("block_x", spots("x")).withColumn("block_y", spots("y")).withColumns(
        {a: (F.col(a) - F.col(f"block_{a}") * side).cast("int") for a in "xy"})
    keys = ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in ("scene_id", "view_id"))
    ddl = f"{keys}, tile_x int, tile_y int, {', '.join(f'p_{c} array<double>' for c in cols)}"
    return rows.groupBy("scene_id", "view_id", "block_x", "block_y").applyInArrow(_tiler(cols, to_arrow_schema(StructType.fromDDL(ddl)), size), ddl)


def in_tiles(pts: DataFrame, cut: DataFrame, cols: list[str], w: Column, h: Column, size: int = TILE) -> DataFrame:
    """Projected points with the arrays ``p_<col>`` of the tile, a row of ``tiles``, that a clamped bilinear sample at u, v reads."""
    at = {f"tile_{a}": F.floor(F.floor(F.least(F.greatest(F.col(n), F.lit(0.0)), side - 1.001)) / size).cast("int") for a, n, side in (("x", "u", w), ("y", "v", h))}
    # Arrays are larger than any estimate of theirs: merged, never broadcast.
    side = cut.select("scene_id", "view_id", "tile_x", "tile_y", *[f"p_{c}" for c in cols]).hint("merge")
    return pts.withColumns(at).join(side, ["scene_id", "view_id", "tile_x", "tile_y"], "left").withColumns(
        {"p_step": F.lit(size + 1), "p_base": (F.col("tile_y") * (size + 1) + F.col("tile_x")) * size}).drop("tile_x", "tile_y")


def in_views(points: DataFrame, cameras: DataFrame, keep: tuple[str, ...] = (), want: str | None = None,
             photos: DataFrame | None = None, deal: Column | None = None, how: str = "inner") -> DataFrame:
    """Every point in every view of its scene, with u, v and camera depth z_cam.

    The camera table has a few rows per scene; the join is on the scene, never a cross product of scenes.
    ``keep`` names camera columns to carry along. With ``want``, a column of ``points``, a point meets that view only.
    With ``photos``, a result of ``pictures``, points also carry the array of the photo, which the samples below then read;
    a column ``part``, by the hash of ``deal``, deals a scene over several tasks. Where points have one view each, the views do that.
    ``how="left"`` keeps points that have no view, with nulls.
    """
    cams, ext, k = flat_cameras(cameras, keep)
    pixel = M.project(F.col("x"), F.col("y"), F.col("z"), ext, k)
    on, carry = (["scene_id"] if want is None else ["scene_id", want]), []
    cams = cams if want is None else cams.withColumn(want, F.col("view_id"))
    if photos is not None:
        carry = ["p_step", "p"]
        # Arrays are larger than any estimate of theirs: merged, never broadcast.
        cams = cams.join(photos.hint("merge"), ["scene_id", "view_id"], "left")
        if want is None:
            points = points.withColumn("part", F.pmod(F.xxhash64(deal), F.lit(PARTS)).cast("int"))
            cams, on = cams.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "part"]
        cams = cams.hint("merge")
    return points.join(cams, on, how).select(*points.columns, "view_id", *keep, *carry, once(u=pixel["u"], v=pixel["v"], z_cam=pixel["z"]))


def _carries(pts: DataFrame, cols: list[str]) -> bool:
    return "p" in pts.columns and set(cols) <= set(pts.schema["p"].dataType.elementType.names)


def _gather(pts: DataFrame, pixels: DataFrame, cols: dict[str, float | bool | int | None], px: Column,
            py: Column) -> DataFrame:
    if _carries(pts, list(cols)):
        at = pts.withColumn("_cell", F.get("p", py * F.col("p_step") + px))
        got = {c: F.col("_cell")[c].cast(pixels.schema[c].dataType) for c in cols}
        return at.withColumns({f"s_{c}": v if cols[c] is None else F.coalesce(v, F.lit(cols[c])) for c, v in got.items()}).drop("_cell")
    table = pixels.select("scene_id", "view_id", F.col("x").alias("_px"), F.col("y").alias("_py"),
                          *[F.col(c).alias(f"s_{c}") for c in cols])
    out = pts.withColumn("_px", px).withColumn("_py", py).join(table, ["scene_id", "view_id", "_px", "_py"], "left")
    for c, default in cols.items():
        if default is not None:
            out = out.withColumn(f"s_{c}", F.coalesce(f"s_{c}", F.lit(default)))
    return out.drop("_px", "_py")


def sample_nearest_clamped(pts: DataFrame, pixels: DataFrame, cols: dict, w: Column, h: Column) -> DataFrame:
    """Nearest pixel by half-even rounding, coordinates clamped into the photo. Adds ``s_<col>``."""
    px = F.least(F.greatest(F.rint("u"), F.lit(0.0)), w - 1.0).cast("int")
    py = F.least(F.greatest(F.rint("v"), F.lit(0.0)), h - 1.0).cast("int")
    return _gather(pts, pixels, cols, px, py)


def sample_nearest(pts: DataFrame, pixels: DataFrame, cols: dict, w: Column, h: Column) -> DataFrame:
    """Nearest pixel by half-up rounding; outside [0, w-1] x [0, h-1] the default value is returned."""
    inside = F.col("u").between(F.lit(0.0), w - 1.0) & F.col("v").between(F.lit(0.0), h - 1.0)
    px = F.when(inside, F.floor(F.col("u") + 0.5).cast("int"))
    py = F.when(inside, F.floor(F.col("v") + 0.5).cast("int"))
    return _gather(pts, pixels, cols, px, py)


def pixel_quads(pixels: DataFrame, cols: list[str]) -> DataFrame:
    """One row per cell with its four corner values: q_<col> = array(c00, c10, c01, c11), missing pixels null.

    Each pixel is sent to the four cells it touches, so that a bilinear gather needs one join instead of four.
    """
    spots = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                      for i, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))])
    spread = pixels.select("*", F.explode(spots).alias("_o"))
    cell = spread.groupBy("scene_id", "view_id", (F.col("x") - F.col("_o.dx")).alias("x"),
                          (F.col("y") - F.col("_o.dy")).alias("y"))
    values = {(c, i): F.max(F.when(F.col("_o.k") == i, F.col(c).cast("double"))) for c in cols for i in range(4)}
    return cell.agg(*[v.alias(f"q{i}_{c}") for (c, i), v in values.items()])


def _bilinear(pts: DataFrame, pixels: DataFrame, cols: list[str], x: Column, y: Column, missing: float) -> DataFrame:
    if _carries(pts, cols):
        at = pts.select("*", once(_fx=x, _fy=y)).withColumns({"_x0": F.floor("_fx").cast("int"), "_y0": F.floor("_fy").cast("int")})
        first, step = F.col("_y0") * F.col("p_step") + F.col("_x0"), F.col("p_step")
        out = at.select("*", once(**{f"_c{i}": F.get("p", first + move) for i, move in enumerate((F.lit(0), F.lit(1), step, step + 1))}))
        return _interpolated(out, cols, missing, lambda i, c: F.col(f"_c{i}")[c]).drop(*[f"_c{i}" for i in range(4)])
    if all(f"p_{c}" in pts.columns for c in cols):  # points carry their tile
        at = pts.select("*", once(_fx=x, _fy=y)).withColumns({"_x0": F.floor("_fx").cast("int"), "_y0": F.floor("_fy").cast("int")})
        at = at.withColumn("_at", F.col("_y0") * F.col("p_step") + F.col("_x0") - F.col("p_base"))
        moves = (F.lit(0), F.lit(1), F.col("p_step"), F.col("p_step") + 1)
        return _interpolated(at, cols, missing, lambda i, c: F.get(f"p_{c}", F.col("_at") + moves[i])).drop("_at")
    quads = pixel_quads(pixels, cols).withColumnsRenamed({"x": "_x0", "y": "_y0"})
    out = pts.withColumns({"_fx": x, "_fy": y})
    out = out.withColumns({"_x0": F.floor("_fx").cast("int"), "_y0": F.floor("_fy").cast("int")}) \
        .join(quads, ["scene_id", "view_id", "_x0", "_y0"], "left")
    return _interpolated(out, cols, missing, lambda i, c: F.col(f"q{i}_{c}")).drop(*[f"q{i}_{c}" for c in cols for i in range(4)])


def _interpolated(out: DataFrame, cols: list[str], missing: float, corner: Callable[[int, str], Column]) -> DataFrame:
    """Bilinear value ``s_<col>`` of each column from the four corners of the cell _x0, _y0 and the position _fx, _fy."""
    dx, dy = F.col("_fx") - F.col("_x0"), F.col("_fy") - F.col("_y0")
    new = {}
    for c in cols:
        q = [F.coalesce(corner(i, c), F.lit(missing)) for i in range(4)]
        new[f"s_{c}"] = (q[0] * (1.0 - dx) + q[1] * dx) * (1.0 - dy) + (q[2] * (1.0 - dx) + q[3] * dx) * dy
    return out.withColumns(new).drop("_fx", "_fy", "_x0", "_y0")


def sample_bilinear_clamped(pts: DataFrame, pixels: DataFrame, cols: list[str], w: Column, h: Column,
                            missing: float = 0.0) -> DataFrame:
    """Bilinear sample with coordinates clamped to w-1.001, h-1.001. Adds ``s_<col>``."""
    x = F.least(F.greatest(F.col("u"), F.lit(0.0)), w - 1.001)
    y = F.least(F.greatest(F.col("v"), F.lit(0.0)), h - 1.001)
    return _bilinear(pts, pixels, cols, x, y, missing)


def sample_bilinear(pts: DataFrame, pixels: DataFrame, cols: dict[str, float], w: Column, h: Column,
                    missing: float = 0.0) -> DataFrame:
    """Bilinear sample; outside the photo each column returns its own constant."""
    inside = F.coalesce(F.col("u").between(F.lit(0.0), w - 1.0) & F.col("v").between(F.lit(0.0), h - 1.0), F.lit(False))
    out = _bilinear(pts.withColumn("_in", inside), pixels, list(cols), F.when(F.col("_in"), F.col("u")),
                    F.when(F.col("_in"), F.col("v")), missing)
    return out.withColumns({f"s_{c}": F.when(F.col("_in"), F.col(f"s_{c}")).otherwise(F.lit(v))
                            for c, v in cols.items()}).drop("_in")
