"""Whole-photo grid work on packed rows: distances, blurs, window sums, morphology and polygon fill.

A photo is packed to one record per pixel row. One pass works along the rows; its records are cut into tiles of columns,
and a second pass works down the columns of a tile. So a pixel is shuffled twice whatever the radius (a morphology tile
also carries a margin, at most as wide as the tile itself). A task holds one row, then one tile of one photo: both are
bounded by the size of a photo.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VIEW = ["scene_id", "view_id"]
#: Columns of a tile, and rows that a worker unpacks at once.
TILE, ROWS = 64, 256

#: Along a row: (positions, one array per value, width, extra) -> array (channels, width).
Along = Callable[[np.ndarray, list[np.ndarray], int, float], np.ndarray]
#: Down a tile: (array (channels, height, margin + columns + margin), margin, first column, width, extra) -> (what to return, value columns).
Down = Callable[[np.ndarray, int, int, int, float], tuple[np.ndarray, list[np.ndarray]]]


def packed_rows(cells: DataFrame, frames: DataFrame, values: tuple[str, ...] = (), extra: Column | None = None) -> DataFrame:
    """One record per pixel row of every photo: its keys, y, w, h, extra and the sorted cells (x, values) in it.

    ``frames`` has scene_id, view_id, w, h, one row per photo; rows without a cell are there too. Cells outside the photo
    are left out; a position given twice keeps the largest values. ``extra`` is one number per photo, of columns of ``frames``.
    """
    extra = F.lit(0.0) if extra is None else extra
    empty = F.lit(None).cast(StructType([f for f in cells.select("x", *values).schema]))
    rows = frames.where("w > 0 AND h > 0").select(*VIEW, F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))).alias("y"), F.col("w").cast("int").alias("w"),
                                                  F.col("h").cast("int").alias("h"), extra.cast("double").alias("extra"), empty.alias("cell"))
    held = cells.select(*VIEW, F.col("y").cast("int").alias("y"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"),
                        F.lit(None).cast("double").alias("extra"), F.struct("x", *values).alias("cell"))
    return rows.unionByName(held).groupBy(*VIEW, "y").agg(
        *[F.max(c).alias(c) for c in ("w", "h", "extra")], F.sort_array(F.collect_set("cell")).alias("cells")).where("w IS NOT NULL")


def _fields(frame: DataFrame) -> str:
    return ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in VIEW)


def two_passes(packed: DataFrame, along: Along, down: Down, columns: str, values: tuple[str, ...] = (), margin: bool = False) -> DataFrame:
    """Run ``along`` on every row and ``down`` on every tile of columns; returns scene_id, view_id, x, y and ``columns``.

    With ``margin`` a tile also sees ``extra`` columns on either side of it, zeros where the photo ends.
    """
    tiles = f"{_fields(packed)}, tile int, y int, w int, h int, extra double, part binary"
    schema = f"{_fields(packed)}, x int, y int, {columns}"
    arrow = {n: to_arrow_schema(StructType.fromDDL(s)) for n, s in (("tiles", tiles), ("out", schema))}

    def span(w: int, extra: float) -> tuple[int, int]:
        reach = int(extra) if margin else 0
        return max(TILE, 2 * reach), reach

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                cells = batch.column("cells")
                ends, held = cells.offsets.to_numpy() - cells.offsets[0].as_py(), cells.flatten()
                xs = held.field("x").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                found = [held.field(v).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) for v in values]
                out = []
                for i, row in enumerate(batch.drop_columns(["cells"]).to_pylist()):
                    w, extra, part = row["w"], row["extra"], slice(ends[i], ends[i + 1])
                    fit = (xs[part] >= 0) & (xs[part] < w)
                    parts = along(xs[part][fit], [v[part][fit] for v in found], w, extra)
                    step, reach = span(w, extra)
                    wide = np.zeros((len(parts), reach + -(-w // step) * step + reach))
                    wide[:, reach:reach + w] = parts
                    for tile, x0 in enumerate(range(0, w, step)):
                        out.append({**row, "tile": tile, "part": wide[:, x0:x0 + reach + min(step, w - x0) + reach].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=arrow["tiles"])

    def tile(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        w, h, extra = first["w"], first["h"], first["extra"]
        step, reach = span(w, extra)
        x0 = first["tile"] * step
        n = min(step, w - x0)
        cube = np.stack([np.frombuffer(p, np.float64) for p in table["part"].to_pylist()]).reshape(h, -1, reach + n + reach)
        cube = np.ascontiguousarray(cube[np.argsort(table["y"].to_numpy())].transpose(1, 0, 2))
        keep, found = down(cube, reach, x0, w, extra)
        ys, xs = np.nonzero(keep)
        fixed = [pa.array([first[k]] * len(ys), arrow["out"].field(k).type) for k in VIEW]
        types = arrow["out"].types[4:]
        return pa.Table.from_arrays([*fixed, pa.array(xs + x0, pa.int32()), pa.array(ys, pa.int32()),
                                     *[pa.array(f[ys, xs], from_pandas=True).cast(t) for f, t in zip(found, types)]], schema=arrow["out"])

    return packed.mapInArrow(rows, tiles).groupBy(*VIEW, "tile").applyInArrow(tile, schema)


def _places(xs: np.ndarray, site: np.ndarray) -> np.ndarray:
    """Index in the sorted ``xs`` of each column's nearest position ``site``; 0 where there is none."""
    return np.minimum(np.searchsorted(xs, np.nan_to_num(site)), max(len(xs) - 1, 0))


def nearest_along(positions: np.ndarray, width: int) -> np.ndarray:
    """Position of the nearest of the sorted ``positions`` for every column, the left one on ties; NaN where there is none."""
    if not len(positions):
        return np.full(width, np.nan)
    x = np.arange(width)
    right = np.searchsorted(positions, x)
    after, before = positions[np.minimum(right, len(positions) - 1)], positions[np.maximum(right - 1, 0)]
    return np.where(np.abs(x - before) <= np.abs(after - x), before, after).astype(np.float64)


def lower_envelope(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min over q of f[q] + (y - q)^2 for every y of every column of ``f`` (height, columns), and the least such q.

    The parabolas of a column are kept on a stack as long as each is lowest somewhere; all columns move together.
    Infinite values have no parabola; a column without any is infinite.
    """
    h, n = f.shape
    sites, starts, top = np.zeros((h, n), np.int64), np.zeros((h, n)), np.full(n, -1)
    for q in range(h):
        live = np.flatnonzero(np.isfinite(f[q]))
        while len(live):
            t = top[live]
            at = np.maximum(t, 0)
            v = sites[at, live]
            with np.errstate(divide="ignore", invalid="ignore"):
                start = np.floor((f[q, live] + q * q - f[v, live] - v * v) / (2.0 * (q - v))) + 1
            start = np.where(t < 0, 0, start)
            spent = (t >= 0) & (start <= starts[at, live])
            keep = ~spent & (start < h)
            top[live[keep]] += 1
            sites[top[live[keep]], live[keep]], starts[top[live[keep]], live[keep]] = q, start[keep]
            live = live[spent]
            top[live] -= 1
    best, nearest, k, columns = np.full((h, n), np.inf), np.zeros((h, n), np.int64), np.zeros(n, np.int64), np.arange(n)
    some = top >= 0
    for y in range(h):
        while True:
            ahead = (k < top) & (starts[np.minimum(k + 1, h - 1), columns] <= y)
            if not ahead.any():
                break
            k[ahead] += 1
        q = sites[k, columns]
        nearest[y] = q
        best[y, some] = f[q[some], columns[some]] + (y - q[some]) ** 2
    return best, nearest


def distance_field(cells: DataFrame, frames: DataFrame, name: str = "distance", within: float | None = None, values: tuple[str, ...] = ()) -> DataFrame:
    """Exact Euclidean distance from every pixel of the photo to the nearest given cell, and that cell (near_x, near_y).

    Ties go to the smaller near_y, then near_x. ``within`` returns only pixels that near; a photo without cells has no rows.
    The ``values`` of the nearest cell follow as near_<value>; cells then are distinct.
    """
    def along(xs, found, w, extra):
        site = nearest_along(xs, w)
        return np.stack([site, *[v[_places(xs, site)] if len(xs) else np.zeros(w) for v in found]])

    def down(cube, reach, x0, w, extra):
        site = cube[0]
        gap = site - (x0 + np.arange(site.shape[1]))
        square, row = lower_envelope(np.where(np.isnan(site), np.inf, gap * gap))
        column = np.take_along_axis(site, row, 0)
        keep = np.isfinite(square) if within is None else square <= within * within
        return keep, [np.sqrt(square), np.nan_to_num(column).astype(np.int32), row.astype(np.int32), *[np.take_along_axis(c, row, 0) for c in cube[1:]]]

    columns = "".join(f", near_{v} double" for v in values)
    return two_passes(packed_rows(cells.select(*VIEW, "x", "y", *values), frames, values), along, down, f"{name} double, near_x int, near_y int{columns}", values)


def signed_distance(mask: DataFrame, frames: DataFrame) -> DataFrame:
    """Exact distance to the mask for pixels outside it, minus the distance to the nearest pixel outside for those inside.

    One row per pixel, ``signed``. A photo that is all mask, or has none, is at the photo's diagonal everywhere.
    """
    def along(xs, _, w, extra):
        inside = np.zeros(w, bool)
        inside[xs] = True
        x = np.arange(w)
        return np.stack([inside.astype(np.float64), np.abs(nearest_along(xs, w) - x), np.abs(nearest_along(np.flatnonzero(~inside), w) - x)])

    def down(cube, reach, x0, w, extra):
        far = float(w * w + cube.shape[1] * cube.shape[1])
        to_mask, to_rest = (np.sqrt(np.minimum(lower_envelope(np.where(np.isnan(c), np.inf, c * c))[0], far)) for c in cube[1:])
        return np.ones(to_mask.shape, bool), [np.where(cube[0] > 0, -to_rest, to_mask)]

    return two_passes(packed_rows(mask.select(*VIEW, "x", "y"), frames), along, down, "signed double")


def _convolve(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Convolution of every row with symmetric ``weights``, the picture mirrored at its first and last pixel."""
    r, n = len(weights) // 2, rows.shape[1]
    wide = np.pad(rows, ((0, 0), (r, r)), mode="reflect") if n > 1 else np.repeat(rows, 2 * r + 1, axis=1)
    out = rows * weights[r]
    for d in range(1, r + 1):
        out = out + weights[r + d] * (wide[:, r - d:r - d + n] + wide[:, r + d:r + d + n])
    return out


def gaussian_weights(sigma: float) -> np.ndarray:
    """Normalised weights of offsets up to four standard deviations, rounded to whole pixels."""
    r = round(4 * sigma)
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2.0 * sigma * sigma))
    return w / w.sum()


def masked_gaussian(pixels: DataFrame, frames: DataFrame, value: str, sigma: float) -> DataFrame:
    """Foreground-normalised Gaussian mean of every pixel of the photo: blur(value * mask) / max(blur(mask), 1e-5).

    ``pixels``: scene_id, view_id, x, y, mask and ``value``. The kernel reaches four standard deviations and the photo is
    mirrored at its borders. Returns blur_<value> and ``weight``, the blurred mask.
    """
    weights = gaussian_weights(sigma)

    def along(xs, values, w, extra):
        rows = np.zeros((2, w))
        rows[0, xs], rows[1, xs] = values[0], 1.0
        return _convolve(rows, weights)

    def down(cube, reach, x0, w, extra):
        total, weight = (_convolve(np.ascontiguousarray(c.T), weights).T for c in cube)
        return np.ones(total.shape, bool), [total / np.maximum(weight, 1e-5), weight]

    held = pixels.where("mask").select(*VIEW, "x", "y", F.col(value).cast("double").alias("_l"))
    return two_passes(packed_rows(held, frames, ("_l",)), along, down, f"blur_{value} double, weight double", ("_l",))


def window_sums(rows: np.ndarray, win: int) -> np.ndarray:
    """Sums of every whole run of ``win`` entries along the last axis."""
    total = np.concatenate([np.zeros((*rows.shape[:-1], 1)), np.cumsum(rows, axis=-1)], axis=-1)
    return total[..., win:] - total[..., :-win]


def similarity(pairs: DataFrame, frames: DataFrame, channels: int = 1, win: int = 7, data_range: float = 255.0) -> DataFrame:
    """Structural similarity of two pictures at the centre of every whole ``win`` window, mean over channels: ``ssim``.

    ``pairs``: scene_id, view_id, x, y and a0, b0, a1, b1, ... for the channels; a missing pixel is 0 in both. Sample
    covariance; window sums are differences of running sums.
    """
    names = tuple(f"{s}{c}" for c in range(channels) for s in "ab")
    half, full = win // 2, win * win
    norm, c1, c2 = full / (full - 1), (0.01 * data_range) ** 2, (0.03 * data_range) ** 2

    def along(xs, values, w, extra):
        out = np.zeros((5 * channels, w))
        if w < win:
            return out
        for c in range(channels):
            a, b = np.zeros(w), np.zeros(w)
            a[xs], b[xs] = values[2 * c], values[2 * c + 1]
            out[5 * c:5 * c + 5, half:w - half] = window_sums(np.stack([a, b, a * a, b * b, a * b]), win)
        return out

    def down(cube, reach, x0, w, extra):
        h, n = cube.shape[1:]
        keep, score = np.zeros((h, n), bool), np.zeros((h, n))
        x = x0 + np.arange(n)
        if h < win or w < win:
            return keep, [score]
        keep[half:h - half, (x >= half) & (x < w - half)] = True
        for c in range(channels):
            sums = window_sums(np.ascontiguousarray(cube[5 * c:5 * c + 5].transpose(0, 2, 1)), win).transpose(0, 2, 1) / full
            ma, mb, aa, bb, ab = sums
            va, vb, vab = (aa - ma * ma) * norm, (bb - mb * mb) * norm, (ab - ma * mb) * norm
            score[half:h - half] += ((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2)) / channels
        return keep, [score]

    return two_passes(packed_rows(pairs, frames, names), along, down, "ssim double", names)


def ellipse(radius: int) -> list[int]:
    """Half widths of the rows -radius..radius of an elliptic kernel."""
    return [round(float(np.sqrt(radius * radius - d * d))) for d in range(-radius, radius + 1)]


def box(radius: int) -> list[int]:
    """Half widths of the rows of a square kernel."""
    return [radius] * (2 * radius + 1)


def _extreme(level: np.ndarray, spans: list[int], pick: np.ufunc, neutral: float) -> np.ndarray:
    """Largest or smallest level under the kernel; positions outside the array are ``neutral``."""
    h, n = level.shape
    r = len(spans) // 2
    out = np.full((h, n), neutral)
    wide, reach = level, 0
    for s, rows in sorted((s, [d - r for d, t in enumerate(spans) if t == s]) for s in set(spans)):
        for shift in range(reach + 1, min(s, n - 1) + 1):
            wide = wide.copy()
            wide[:, :n - shift] = pick(wide[:, :n - shift], level[:, shift:])
            wide[:, shift:] = pick(wide[:, shift:], level[:, :n - shift])
        reach = max(reach, s)
        for d in rows:
            a, b = max(0, -d), min(h, h - d)
            if a < b:
                out[a:b] = pick(out[a:b], wide[a + d:b + d])
    return out


def morph(levels: DataFrame, frames: DataFrame, steps: tuple[str, ...], kernel: Callable[[int], list[int]] = ellipse, radius: int | Column = 1) -> DataFrame:
    """Grey dilation ("grow") and erosion ("shrink"), in the order of ``steps``, under a kernel of the photo's ``radius``.

    ``levels``: scene_id, view_id, x, y, level; a missing pixel is 0. Positions outside the photo never count. Returns the
    pixels above 0. ``radius`` may be an expression of columns of ``frames``; 0 changes nothing.
    """
    grown = F.lit(radius) if isinstance(radius, int) else radius

    def along(xs, values, w, extra):
        row = np.zeros((1, w))
        row[0, xs] = values[0]
        return row

    def down(cube, reach, x0, w, extra):
        level, x = cube[0], x0 - reach + np.arange(cube.shape[2])
        outside, spans = (x < 0) | (x >= w), kernel(reach // len(steps))
        for step in steps:
            pick, neutral = (np.maximum, -np.inf) if step == "grow" else (np.minimum, np.inf)
            level = np.where(outside, neutral, level)
            level = _extreme(level, spans, pick, neutral)
        level = level[:, reach:level.shape[1] - reach]
        return level > 0, [level]

    held = levels.select(*VIEW, "x", "y", F.col("level").cast("double").alias("level"))
    return two_passes(packed_rows(held, frames, ("level",), grown * len(steps)), along, down, "level double", ("level",), margin=True)


def dilate(cells: DataFrame, frames: DataFrame, kernel: Callable[[int], list[int]] = ellipse, radius: int | Column = 1) -> DataFrame:
    """Pixels of the photo under a kernel set on any given cell."""
    return morph(cells.withColumn("level", F.lit(1)), frames, ("grow",), kernel, radius).drop("level")


def erode(cells: DataFrame, frames: DataFrame, kernel: Callable[[int], list[int]] = ellipse, radius: int | Column = 1) -> DataFrame:
    """Given cells whose whole kernel, as far as it lies in the photo, is given."""
    return morph(cells.withColumn("level", F.lit(1)), frames, ("shrink",), kernel, radius).drop("level")


def close(cells: DataFrame, frames: DataFrame, kernel: Callable[[int], list[int]] = ellipse, radius: int | Column = 1) -> DataFrame:
    """Dilate, then erode."""
    return morph(cells.withColumn("level", F.lit(1)), frames, ("grow", "shrink"), kernel, radius).drop("level")


def polygon_spans(polygons: DataFrame, frames: DataFrame) -> DataFrame:
    """Runs of pixels x0..x1 of row y whose centres lie in a polygon; even-odd, a left or lower border is inside.

    ``polygons``: scene_id, view_id, polygon_id and ``points`` array<struct<x, y>>. Every edge enters the rows that it
    crosses; the crossings of a row, sorted, pair up to runs, which are clipped to the photo.
    """
    edges = polygons.join(frames.select(*VIEW, "w", "h"), VIEW).where(F.size("points") > 2).select(*VIEW, "polygon_id", "w", "h", F.inline(F.transform(
        "points", lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.col("points")[(i + 1) % F.size("points")].alias("b")))))
    edges = edges.select("*", F.col("b.x").alias("bx"), F.col("b.y").alias("by")).where("ay <> by")
    low, high = F.greatest(F.ceil(F.least("ay", "by")), F.lit(0)), F.least(F.ceil(F.greatest("ay", "by")), F.col("h")) - 1
    rows = edges.withColumns({"_lo": low, "_hi": high}).where("_lo <= _hi").withColumn("y", F.explode(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int"))))
    crossing = F.col("ax") + (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay"))
    sides = rows.groupBy(*VIEW, "polygon_id", "y", "w").agg(F.sort_array(F.collect_list(F.ceil(crossing))).alias("c"))
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 2).cast("int") - 1), lambda i: F.struct(
        F.greatest(F.col("c")[2 * i], F.lit(0)).cast("int").alias("x0"), F.least(F.col("c")[2 * i + 1] - 1, F.col("w") - 1).cast("int").alias("x1")))
    return sides.select(*VIEW, "polygon_id", "y", F.inline(runs)).where("x0 <= x1")


def polygon_cells(polygons: DataFrame, frames: DataFrame) -> DataFrame:
    """Pixels of the photo inside any polygon of its view, each once."""
    return polygon_spans(polygons, frames).select(*VIEW, F.explode(F.sequence("x0", "x1")).alias("x"), "y").distinct()
