"""Camera and pixel-map arithmetic on row-major arrays of doubles.

``ext`` is a world-to-camera 3x4 array of 12, ``k`` a 3x3 intrinsic array of 9, pixel maps are 3x3 arrays of 9. Where
only elements are read, a list of 12 or 9 columns does as well as an array column.
Pixel coordinates are integer centres with a top-left origin.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(value) -> Column:
    return F.lit(float(value)) if isinstance(value, (int, float)) else value.cast("double")


def vector(*items) -> Column:
    return F.array(*[_d(i) for i in items])


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once; keeps composed matrix expressions linear in size."""
    return F.transform(F.array(value), body)[0]


def orientation_matrix(w: Column, h: Column, o: Column) -> Column:
    """Encoded pixel -> displayed pixel for orientation 1..8; null for any other value or empty size."""
    x, y = w - 1, h - 1
    # The eight display orientations.
    rows = {
        1: (1, 0, 0, 0, 1, 0), 2: (-1, 0, x, 0, 1, 0), 3: (-1, 0, x, 0, -1, y), 4: (1, 0, 0, 0, -1, y),
        5: (0, 1, 0, 1, 0, 0), 6: (0, -1, y, 1, 0, 0), 7: (0, -1, y, -1, 0, x), 8: (0, 1, 0, -1, 0, x),
    }
    sized = (w > 0) & (h > 0)
    out = None
    for code, top in rows.items():
        cond, value = sized & (o == code), vector(*top, 0, 0, 1)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out


def working_transform(m: Column, sx: Column, sy: Column) -> Column:
    """Scale rows 0 and 1 of a pixel map and move both offsets by the half-pixel of the resize."""
    return F.array(m[0] * sx, m[1] * sx, m[2] * sx + (sx - 1) / 2, m[3] * sy, m[4] * sy, m[5] * sy + (sy - 1) / 2,
                   m[6], m[7], m[8])


def matmul3(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j]
                     for i in range(3) for j in range(3)])


def letterbox(w: Column, h: Column, size: int) -> Column:
    """Fit (w, h) into a square: struct of resized size, padding and the 3x3 map (half-even size rounding)."""
    scale = F.lit(float(size)) / F.greatest(w, h)
    nw, nh = F.rint(w * scale), F.rint(h * scale)
    left, top = F.floor((size - nw) / 2), F.floor((size - nh) / 2)
    sx, sy = nw / w, nh / h
    return F.struct(nw.cast("int").alias("width"), nh.cast("int").alias("height"), left.cast("int").alias("left"),
                    top.cast("int").alias("top"),
                    vector(sx, 0, left + (sx - 1) / 2, 0, sy, top + (sy - 1) / 2, 0, 0, 1).alias("transform"))


def affine_inverse(m: Column) -> Column:
    """Inverse of a pixel map whose last row is 0 0 1; null when it is singular."""
    det = F.nullif(m[0] * m[4] - m[1] * m[3], F.lit(0.0))
    return F.when(det.isNotNull(), vector(
        m[4] / det, -m[1] / det, (m[1] * m[5] - m[2] * m[4]) / det,
        -m[3] / det, m[0] / det, (m[2] * m[3] - m[0] * m[5]) / det, 0, 0, 1))


def _inverse_items(m: Column) -> list[Column]:
    c = [m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
         m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
         m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3]]
    det = F.nullif(m[0] * c[0] + m[1] * c[3] + m[2] * c[6], F.lit(0.0))
    return [x / det for x in c]


def inverse3(m: Column) -> Column:
    """General 3x3 inverse by cofactors; elements are null when it is singular."""
    return F.array(*_inverse_items(m))


def transpose3(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def resize_map(sx: Column, sy: Column) -> Column:
    """Pixel map of a resize, with the half-pixel offsets."""
    return vector(sx, 0, (sx - 1) / 2, 0, sy, (sy - 1) / 2, 0, 0, 1)


def full_intrinsics(model_k: Column, work_to_model: Column, work_w: Column, work_h: Column, full_w: Column,
                    full_h: Column) -> Column:
    """Intrinsics on the upright full-size photo: (work->model . full->work)^-1 . K."""
    full_to_work = resize_map(work_w / full_w, work_h / full_h)
    chain = let(work_to_model, lambda a: let(full_to_work, lambda b: matmul3(a, b)))
    return let(let(chain, affine_inverse), lambda i: matmul3(i, model_k))


def resize_intrinsics(k: Column, s: Column) -> Column:
    return let(resize_map(s, s), lambda r: matmul3(r, k))


def to_camera(x: Column, y: Column, z: Column, ext: Column) -> tuple[Column, Column, Column]:
    """World point in camera axes (right, down, forward)."""
    return tuple(ext[4 * i] * x + ext[4 * i + 1] * y + ext[4 * i + 2] * z + ext[4 * i + 3] for i in range(3))


def project(x: Column, y: Column, z: Column, ext: Column, k: Column) -> Column:
    """struct(u, v, z): pixel position and camera depth; u and v are null on the camera plane."""
    cx, cy, cz = to_camera(x, y, z, ext)
    w = F.nullif(k[6] * cx + k[7] * cy + k[8] * cz, F.lit(0.0))
    return F.struct(((k[0] * cx + k[1] * cy + k[2] * cz) / w).alias("u"),
                    ((k[3] * cx + k[4] * cy + k[5] * cz) / w).alias("v"), cz.alias("z"))


def backproject(u: Column, v: Column, depth: Column, ext: Column, k: Column) -> Column:
    """struct(x, y, z): the world point of a pixel at the given depth."""
    i = _inverse_items(k)
    cx = (i[0] * u + i[1] * v + i[2]) * depth - ext[3]
    cy = (i[3] * u + i[4] * v + i[5]) * depth - ext[7]
    cz = (i[6] * u + i[7] * v + i[8]) * depth - ext[11]
    return F.struct(*[(cx * ext[j] + cy * ext[4 + j] + cz * ext[8 + j]).alias(n) for j, n in enumerate("xyz")])


def camera_centre(ext: Column) -> Column:
    """struct(x, y, z) of the camera position, -R^T t."""
    return F.struct(*[(-(ext[j] * ext[3] + ext[4 + j] * ext[7] + ext[8 + j] * ext[11])).alias(n)
                      for j, n in enumerate("xyz")])


def fundamental(ext_a: Column, k_a: Column, ext_b: Column, k_b: Column) -> Column:
    """Fundamental matrix of the ordered camera pair a -> b: K_b^-T [t]x R K_a^-1."""
    turn = (0, 1, 2, 4, 5, 6, 8, 9, 10)
    ra, rb = F.array(*[ext_a[i] for i in turn]), F.array(*[ext_b[i] for i in turn])

    def with_rotation(r: Column) -> Column:
        t = F.array(*[ext_b[4 * i + 3] - (r[3 * i] * ext_a[3] + r[3 * i + 1] * ext_a[7] + r[3 * i + 2] * ext_a[11])
                      for i in range(3)])
        skew = let(t, lambda v: vector(0, -v[2], v[1], v[2], 0, -v[0], -v[1], v[0], 0))
        left = let(let(inverse3(k_b), transpose3), lambda i: let(skew, lambda s: matmul3(i, s)))
        right = let(inverse3(k_a), lambda i: matmul3(r, i))
        return let(left, lambda p: let(right, lambda q: matmul3(p, q)))

    return let(let(rb, lambda b: let(let(ra, transpose3), lambda a: matmul3(b, a))), with_rotation)


def sampson(xa: Column, ya: Column, xb: Column, yb: Column, f: Column) -> Column:
    """First-order epipolar distance of a match, in pixels."""
    l0, l1, l2 = (f[3 * i] * xa + f[3 * i + 1] * ya + f[3 * i + 2] for i in range(3))
    m0, m1 = (f[j] * xb + f[3 + j] * yb + f[6 + j] for j in range(2))
    return F.abs(xb * l0 + yb * l1 + l2) / F.sqrt(l0 * l0 + l1 * l1 + m0 * m0 + m1 * m1 + 1e-20)


def in_frame(u: Column, v: Column, z: Column, left: Column, top: Column, w: Column, h: Column) -> Column:
    """In front of the camera and inside [left, left+w-1) x [top, top+h-1); padding is never inside."""
    ok = (z > 0) & (u >= left) & (u < left + w - 1) & (v >= top) & (v < top + h - 1)
    return F.coalesce(ok, F.lit(False))


def in_texture_frame(u: Column, v: Column, z: Column, w: Column, h: Column) -> Column:
    """In front of the camera and inside [1, w-2) x [1, h-2), so that bilinear taps never leave the photo."""
    ok = (z > 0) & (u >= 1) & (u < w - 2) & (v >= 1) & (v < h - 2)
    return F.coalesce(ok, F.lit(False))


def triangle(ax, ay, az, bx, by, bz, cx, cy, cz) -> Column:
    """struct(area, nx, ny, nz, mx, my, mz): area, unit normal and centroid of a triangle in space."""
    ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
    px, py, pz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    length = F.sqrt(px * px + py * py + pz * pz)
    unit = F.nullif(length, F.lit(0.0))
    return F.struct((length / 2).alias("area"), (px / unit).alias("nx"), (py / unit).alias("ny"),
                    (pz / unit).alias("nz"), ((ax + bx + cx) / 3).alias("mx"), ((ay + by + cy) / 3).alias("my"),
                    ((az + bz + cz) / 3).alias("mz"))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd ray cast against an array<struct<x,y>>.

    An edge is crossed when exactly one end lies above the point, so a point on the lower or left border is inside
    and one on the upper or right border outside.
    """
    shifted = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    crossings = F.aggregate(
        F.arrays_zip(polygon.alias("a"), shifted.alias("b")), F.lit(0),
        lambda n, e: n + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < e["a"]["x"] + (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"])
               / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0))), 1).otherwise(0))
    return crossings % 2 == 1
