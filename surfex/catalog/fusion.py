"""Votes, voxel fields, support and surfaces."""

from pyspark.sql import functions as F

from ..operators import fusion as U
from ..operators import mesh as H
from ..session import cut_lineage
from . import bindings  # noqa: F401
from .geometry import INSIDE, MASK, bilinear_sql, rounded
from .mesh import TRI
from .registry import bind, query
from .text import camera, pixel, r6

RES = 18

# Cloud of every scene for votes; depth grids with a plain silhouette distance column.
bind("cloud", "SELECT scene_id, view_id, point_id, x, y, z FROM points")
bind("grids", "SELECT scene_id, view_id, x, y, depth, confidence, mask, CASE WHEN mask THEN -confidence ELSE confidence END AS signed FROM pixels")
bind("photo_cameras", "SELECT scene_id, view_id, ext, k, w, h, CAST(2 AS INT) AS left, CAST(1 AS INT) AS top, CAST(36 AS INT) AS w_photo, CAST(28 AS INT) AS h_photo FROM cameras".replace("left,", "pad_left,").replace("top,", "pad_top,"))

VOTES = f"""{MASK}, dil AS MATERIALIZED (SELECT DISTINCT ((scene_id*5+view_id)*30+y+dy)*40+x+dx AS key FROM m, (SELECT unnest(generate_series(-5, 5)) AS dx) a, (SELECT unnest(generate_series(-5, 5)) AS dy) b WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29),
cl AS (SELECT *, {pixel()} FROM (SELECT p.*, c.ext, c.k, c.w, c.h, c.view_id AS cam, {camera('p.x','p.y','p.z')} FROM cloud p JOIN cameras c ON p.scene_id = c.scene_id)),
vt AS (SELECT scene_id, point_id, x, y, z, count(*) FILTER (d.key IS NOT NULL AND cz > 0) AS votes FROM cl LEFT JOIN dil d ON d.key = CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN ((scene_id*5+cam)*30+floor(v+0.5)::BIGINT)*40+floor(u+0.5)::BIGINT END GROUP BY 1,2,3,4,5),
nv AS (SELECT scene_id, greatest(2, ceil(count(*)*0.7::DOUBLE)) AS bound, greatest(2, ceil(count(*)*0.55::DOUBLE)) AS interior FROM cameras GROUP BY 1),
kept AS MATERIALIZED (SELECT vt.* FROM vt JOIN nv ON vt.scene_id = nv.scene_id WHERE votes >= bound)"""
SPEC = f"""ex AS (SELECT scene_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM kept GROUP BY 1), ey AS (SELECT *, greatest(hx-lx, hy-ly, hz-lz)/{RES - 12}::DOUBLE AS spacing FROM ex),
spec AS (SELECT scene_id, spacing, lx+spacing*-6 AS lox, ly+spacing*-6 AS loy, lz+spacing*-6 AS loz, (ceil(((hx+spacing*6)-(lx+spacing*-6))/spacing)+1)::INT AS nx, (ceil(((hy+spacing*6)-(ly+spacing*-6))/spacing)+1)::INT AS ny, (ceil(((hz+spacing*6)-(lz+spacing*-6))/spacing)+1)::INT AS nz FROM ey),
vx AS (SELECT *, lox+i*spacing AS x, loy+j*spacing AS y, loz+k_*spacing AS z, i = 0 OR j = 0 OR k_ = 0 OR i = nx-1 OR j = ny-1 OR k_ = nz-1 AS shell FROM (SELECT *, unnest(generate_series(0, nz-1)) AS k_ FROM (SELECT *, unnest(generate_series(0, ny-1)) AS j FROM (SELECT *, unnest(generate_series(0, nx-1)) AS i FROM spec))))"""
EVIDENCE = f"""ev0 AS (SELECT *, {pixel()} FROM (SELECT v.scene_id, v.i, v.j, v.k_, v.spacing, v.shell, c.view_id, c.ext, c.k, c.w, c.h, c.pad_left, c.pad_top, c.w_photo, c.h_photo, {camera('v.x','v.y','v.z')} FROM vx v JOIN photo_cameras c ON v.scene_id = c.scene_id)),
ev1 AS ({bilinear_sql('ev0', ['signed', 'depth', 'confidence'], *INSIDE).replace('JOIN pixels', 'JOIN grids')}),
ev2 AS (SELECT e.*, coalesce(g.mask, false) AS inside, coalesce(cz > 0 AND u >= pad_left AND u < pad_left+w_photo-1 AND v >= pad_top AND v < pad_top+h_photo-1, false) AS seen,
 CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN s_signed ELSE 1000 END AS sg, CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN s_depth ELSE 0 END AS dp, CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN s_confidence ELSE 0 END AS cf
 FROM ev1 e LEFT JOIN grids g ON ((g.scene_id*5+g.view_id)*30+g.y)*40+g.x = CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN ((e.scene_id*5+e.view_id)*30+floor(v+0.5)::BIGINT)*40+floor(u+0.5)::BIGINT END),
ev3 AS (SELECT *, spacing*4 AS tau, coalesce(seen AND inside AND dp-cz >= -spacing*4, false) AS use FROM ev2),
ev AS MATERIALIZED (SELECT scene_id, i, j, k_, view_id, spacing, shell, seen, inside, use, CASE WHEN use THEN least(greatest(dp-cz, -tau), tau) ELSE 0 END AS d, CASE WHEN use THEN least(greatest(cf-1, 0.1), 5) ELSE 0 END AS certainty,
 CASE WHEN seen THEN (sg-2)*cz/((k[1]+k[5])/2) ELSE -tau END AS silhouette FROM ev3)"""


def _kept(t):
    return U.consensus_points(t.cloud.drop("view_id"), t.cameras, t.pixels.where("mask"))


def _spec(t):
    return U.grid_spec(_kept(t), RES)


def _evidence(t, spec=None):
    cams = t.photo_cameras.withColumnsRenamed({"pad_left": "left", "pad_top": "top"})
    return U.voxel_evidence(U.voxel_rows(_spec(t) if spec is None else spec), cams, t.grids)


@query("g2_consensus_points", f"WITH {VOTES} SELECT scene_id, point_id, votes FROM kept")
def _(t):
    return _kept(t).select("scene_id", "point_id", "votes")


@query("g2_enough_points", f"WITH {VOTES} SELECT scene_id, count(*) AS points, count(*) >= 1001 AS enough FROM kept GROUP BY 1")
def _(t):
    return U.enough_points(_kept(t))


@query("g6_voxel_grid", f"WITH {VOTES}, {SPEC} SELECT scene_id, {r6('spacing','spacing')}, nx, ny, nz, {r6('lox','lox')}, {r6('loy','loy')}, {r6('loz','loz')} FROM spec")
def _(t):
    return _spec(t).select("scene_id", "nx", "ny", "nz", *[rounded(F.col(c), c) for c in ("spacing", "lox", "loy", "loz")])


@query("g6_voxel_rows", f"WITH {VOTES}, {SPEC} SELECT scene_id, i::INT AS i, count(*) AS voxels, count(*) FILTER (shell) AS shell, {r6('sum(x+y+z)','position_sum')} FROM vx GROUP BY 1, 2")
def _(t):
    return U.voxel_rows(_spec(t)).groupBy("scene_id", "i").agg(F.count("*").alias("voxels"), F.count_if("shell").alias("shell"), rounded(F.sum(F.col("x") + F.col("y") + F.col("z")), "position_sum"))


@query("f35_depth_evidence", f"WITH {VOTES}, {SPEC}, {EVIDENCE} SELECT scene_id, i::INT AS i, j::INT AS j, k_::INT AS k, view_id, {r6('d','d')}, {r6('certainty','certainty')} FROM ev WHERE use")
def _(t):
    return _evidence(t).where("use").select("scene_id", "i", "j", "k", "view_id", rounded(F.col("d"), "d"), rounded(F.col("certainty"), "certainty"))


@query("f36_silhouette_distance", f"WITH {VOTES}, {SPEC}, {EVIDENCE} SELECT scene_id, view_id, i::INT AS i, {r6('min(silhouette)','low')}, {r6('max(silhouette)','high')} FROM ev GROUP BY 1, 2, 3")
def _(t):
    return _evidence(t).groupBy("scene_id", "view_id", "i").agg(rounded(F.min("silhouette"), "low"), rounded(F.max("silhouette"), "high"))


FIELD = "fr AS (SELECT scene_id, i, j, k_, spacing, shell, sum(d*certainty) AS s, sum(certainty) AS weight, max(silhouette) AS hull, count(*) FILTER (seen AND inside) AS foreground_views FROM ev GROUP BY ALL), fs AS (SELECT * REPLACE (greatest(hull, -spacing*4) AS hull) FROM fr), fd AS (SELECT f.*, CASE WHEN shell THEN spacing*4 ELSE greatest(CASE WHEN weight > 0 THEN s/greatest(weight,1e-6) WHEN foreground_views >= interior THEN -spacing*4 ELSE spacing*4 END, hull, -spacing*4) END AS field FROM fs f JOIN nv ON f.scene_id = nv.scene_id)"


def _field(t, spec=None):
    return U.fuse_voxels(_evidence(t, spec), U.view_counts(t.cameras))


@query("g5_fuse_voxels", f"WITH {VOTES}, {SPEC}, {EVIDENCE}, {FIELD} SELECT scene_id, i::INT AS i, j::INT AS j, k_::INT AS k, {r6('field','field')} FROM fd")
def _(t):
    return _field(t).select("scene_id", "i", "j", "k", rounded(F.col("field"), "field"))


@query("g3_foreground_views", f"WITH {VOTES}, {SPEC}, {EVIDENCE}, {FIELD} SELECT scene_id, foreground_views, count(*) AS voxels FROM fd GROUP BY 1, 2")
def _(t):
    return _field(t).groupBy("scene_id", "foreground_views").agg(F.count("*").alias("voxels"))


@query("g4_visual_hull", f"WITH {VOTES}, {SPEC}, {EVIDENCE}, {FIELD} SELECT scene_id, i::INT AS i, j::INT AS j, k_::INT AS k, {r6('hull','hull')} FROM fd")
def _(t):
    return _field(t).select("scene_id", "i", "j", "k", rounded(F.col("hull"), "hull"))


def _surface(t):
    """Faces and vertices; the votes are counted once, for the grid that both the field and its surface read."""
    spec = cut_lineage(_spec(t))
    return U.extract_surface(_field(t, spec), spec)


_TETS = ", ".join(f"({n}, [{', '.join(map(str, tet))}])" for n, tet in enumerate(U.TETRAHEDRA))


@query("r5_extract_surface", f"""WITH {VOTES}, {SPEC}, {EVIDENCE}, {FIELD}, g AS MATERIALIZED (SELECT f.scene_id, i, j, k_, field, s.ny, s.nz, ((f.scene_id*100+i)*100+j)*100+k_ AS key FROM fd f JOIN spec s ON f.scene_id = s.scene_id),
cu AS (SELECT a.*, {', '.join(f'g{b}.field AS f{b}' for b in range(1, 8))} FROM g a {' '.join(f'JOIN g g{b} ON a.key + {(b & 1) * 10000 + (b >> 1 & 1) * 100 + (b >> 2)} = g{b}.key' for b in range(1, 8))}),
ca AS (SELECT scene_id, ny, nz, (i*ny+j)*nz+k_ AS n0, [field, {', '.join(f'f{b}' for b in range(1, 8))}] AS f FROM cu),
te AS (SELECT ca.*, tid, list_filter(tet, lambda c: f[c+1] < 0) AS lo, list_filter(tet, lambda c: f[c+1] >= 0) AS hi FROM ca, (VALUES {_TETS}) v(tid, tet)),
tr AS (SELECT scene_id, n0, ny, nz, tid, unnest(CASE len(lo) WHEN 1 THEN [[[lo[1], hi[1]], [lo[1], hi[2]], [lo[1], hi[3]]]] WHEN 3 THEN [[[lo[1], hi[1]], [lo[2], hi[1]], [lo[3], hi[1]]]]
  ELSE [[[lo[1], hi[1]], [lo[1], hi[2]], [lo[2], hi[2]]], [[lo[1], hi[1]], [lo[2], hi[2]], [lo[2], hi[1]]]] END) AS t, generate_subscripts(CASE len(lo) WHEN 2 THEN [0, 1] ELSE [0] END, 1) - 1 AS half FROM te WHERE len(lo) BETWEEN 1 AND 3),
ve AS (SELECT scene_id, n0*12+tid*2+half AS fid, list_sort(list_transform(t, lambda e: (n0 + (least(e[1], e[2]) & 1)*ny*nz + (least(e[1], e[2]) >> 1 & 1)*nz + (least(e[1], e[2]) >> 2))*8 + greatest(e[1], e[2]) - least(e[1], e[2]))) AS v FROM tr)
SELECT scene_id, fid::BIGINT AS fid, v[1]::BIGINT AS low_vertex, v[2]::BIGINT AS middle_vertex, v[3]::BIGINT AS high_vertex FROM ve""")
def _(t):
    faces, _ = _surface(t)
    v = F.sort_array(F.array("v0", "v1", "v2"))
    return faces.select("scene_id", "fid", v[0].alias("low_vertex"), v[1].alias("middle_vertex"), v[2].alias("high_vertex"))


@query("r5_lattice_crossings", f"""WITH {VOTES}, {SPEC}, {EVIDENCE}, {FIELD}, g AS MATERIALIZED (SELECT f.*, s.ny, s.nz, ((f.scene_id*100+i)*100+j)*100+k_ AS key, ((i*s.ny+j)*s.nz+k_)*8 AS node FROM fd f JOIN spec s ON f.scene_id = s.scene_id)
SELECT a.scene_id, (a.node + e.bit)::BIGINT AS vid FROM g a CROSS JOIN (VALUES (1, 10000), (2, 100), (4, 1)) e(bit, step) JOIN g b ON a.key + e.step = b.key WHERE (a.field < 0) <> (b.field < 0)""")
def _(t):
    _, vertices = _surface(t)
    return vertices.where("vid % 8 IN (1, 2, 4)").select("scene_id", "vid")


NORMALS = f"{TRI}, ns AS (SELECT scene_id, vid, sum(px/len) AS nx, sum(py/len) AS ny, sum(pz/len) AS nz FROM (SELECT scene_id, v0 AS vid, px, py, pz, len FROM tri UNION ALL SELECT scene_id, v1, px, py, pz, len FROM tri UNION ALL SELECT scene_id, v2, px, py, pz, len FROM tri) GROUP BY 1, 2), nm AS (SELECT v.scene_id, v.vid, v.x, v.y, v.z, nx/sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny/sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz/sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM ns JOIN vertices v ON ns.scene_id*1000+ns.vid = v.scene_id*1000+v.vid)"


@query("f38_vertex_support", f"""WITH {NORMALS}, sv0 AS (SELECT *, {pixel()} FROM (SELECT n.*, c.view_id, c.ext, c.k, c.w, c.h, {camera('n.x','n.y','n.z')} FROM nm n JOIN cameras c ON n.scene_id = c.scene_id)), sv1 AS ({bilinear_sql('sv0', ['depth'], *INSIDE)}),
sv2 AS (SELECT e.*, abs(cz - CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN s_depth ELSE 0 END) AS gap, -(ext[1]*ext[4]+ext[5]*ext[8]+ext[9]*ext[12])-e.x AS dx, -(ext[2]*ext[4]+ext[6]*ext[8]+ext[10]*ext[12])-e.y AS dy, -(ext[3]*ext[4]+ext[7]*ext[8]+ext[11]*ext[12])-e.z AS dz
 FROM sv1 e JOIN pixels g ON g.mask AND ((g.scene_id*5+g.view_id)*30+g.y)*40+g.x = CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN ((e.scene_id*5+e.view_id)*30+floor(v+0.5)::BIGINT)*40+floor(u+0.5)::BIGINT END WHERE cz > 0)
SELECT scene_id, vid, view_id, {r6('greatest((nx*dx+ny*dy+nz*dz)/greatest(sqrt(dx*dx+dy*dy+dz*dz),1e-8),0)*exp(-gap/0.4::DOUBLE)','score')} FROM sv2 WHERE gap < 0.4::DOUBLE*1.5""")
def _(t):
    normals = H.vertex_normals(H.face_metrics(t.corners))
    return U.vertex_support(t.vertices.join(normals, ["scene_id", "vid"]), t.cameras, t.pixels, 0.4).select("scene_id", "vid", "view_id", rounded(F.col("score"), "score"))
