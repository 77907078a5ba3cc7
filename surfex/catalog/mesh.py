"""Mesh queries over the lattice surfaces."""

from pyspark.sql import functions as F

from ..functions import matrices as M
from ..operators import ledger as L
from ..operators import mesh as H
from ..operators import ranking as K
from ..operators import rules as R
from . import bindings  # noqa: F401
from .geometry import rounded
from .registry import query
from .text import r6

TRI = """tri AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS len, (x0+x1+x2)/3 AS mx, (y0+y1+y2)/3 AS my, (z0+z1+z2)/3 AS mz FROM (SELECT *, uy*wz-uz*wy AS px, uz*wx-ux*wz AS py, ux*wy-uy*wx AS pz
 FROM (SELECT *, x1-x0 AS ux, y1-y0 AS uy, z1-z0 AS uz, x2-x0 AS wx, y2-y0 AS wy, z2-z0 AS wz FROM corners)))"""
# Minimum label over neighbours until nothing changes: the recursive check of the component operator.
PARTS = """kadj AS MATERIALIZED (SELECT a.scene_id*1000+a.fid_a AS p, a.scene_id*1000+a.fid_b AS q FROM adjacency a JOIN faces_kept x ON a.scene_id*1000+a.fid_a = x.scene_id*1000+x.fid JOIN faces_kept y ON a.scene_id*1000+a.fid_b = y.scene_id*1000+y.fid),
sym AS MATERIALIZED (SELECT p, q FROM kadj UNION ALL SELECT q, p FROM kadj),
spread(n, p, label, moved) AS (SELECT 0, scene_id*1000+fid, scene_id*1000+fid, 1 FROM faces_kept UNION ALL
 SELECT n, p, least(label, low), sum(CASE WHEN low < label THEN 1 ELSE 0 END) OVER ()::INT FROM (SELECT l.n+1 AS n, l.p, l.label, coalesce(m.low, l.label) AS low FROM spread l LEFT JOIN
  (SELECT s.p, min(o.label) AS low FROM sym s JOIN spread o ON s.q = o.p GROUP BY s.p) m ON l.p = m.p WHERE l.moved > 0 AND l.n < 400)),
parts AS MATERIALIZED (SELECT p // 1000 AS scene_id, p % 1000 AS fid, min(label) % 1000 AS component FROM spread GROUP BY p)"""
SUPPORT = "sup AS (SELECT f.scene_id, f.fid, a.view_id FROM faces f JOIN vertex_support a ON f.scene_id*1000+f.v0 = a.scene_id*1000+a.vid JOIN vertex_support b ON (f.scene_id*1000+f.v1)*5+a.view_id = (b.scene_id*1000+b.vid)*5+b.view_id JOIN vertex_support c ON (f.scene_id*1000+f.v2)*5+a.view_id = (c.scene_id*1000+c.vid)*5+c.view_id)"


def _metrics(t):
    return H.face_metrics(H.with_corners(t.faces, t.vertices))


def _parts(t):
    kept = t.faces_kept
    return H.components(H.face_adjacency(kept), kept)


@query("j8_face_corners", "SELECT scene_id, fid, x0, y0, z0, x1, y1, z1, x2, y2, z2 FROM corners")
def _(t):
    return H.with_corners(t.faces, t.vertices).select("scene_id", "fid", *[f"{a}{i}" for i in range(3) for a in "xyz"])


@query("f21_face_metrics", f"WITH {TRI} SELECT scene_id, fid, {r6('len/2','area')}, {r6('px/len','nx')}, {r6('py/len','ny')}, {r6('pz/len','nz')}, {r6('mx','mx')}, {r6('my','my')}, {r6('mz','mz')} FROM tri")
def _(t):
    return _metrics(t).select("scene_id", "fid", *[rounded(F.col(c), c) for c in ("area", "nx", "ny", "nz", "mx", "my", "mz")])


@query("f21_mesh_bounds", "SELECT scene_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS extent FROM vertices GROUP BY 1")
def _(t):
    return H.mesh_bounds(t.vertices)


@query("j9_face_adjacency", "SELECT scene_id, fid_a, fid_b, va, vb FROM adjacency")
def _(t):
    return H.face_adjacency(t.faces)


@query("g31_watertight", """WITH e AS (SELECT scene_id, va, vb, count(*) AS n FROM half_edges GROUP BY 1, 2, 3) SELECT scene_id, bool_and(n = 2) AS watertight, count(*) AS edges FROM e GROUP BY 1""")
def _(t):
    return H.is_watertight(t.faces)


@query("g31_vertex_normals", f"""WITH {TRI}, s AS (SELECT scene_id, vid, sum(px/len) AS x, sum(py/len) AS y, sum(pz/len) AS z FROM (SELECT scene_id, v0 AS vid, px, py, pz, len FROM tri UNION ALL SELECT scene_id, v1, px, py, pz, len FROM tri UNION ALL SELECT scene_id, v2, px, py, pz, len FROM tri) GROUP BY 1, 2)
SELECT scene_id, vid, {r6('x/sqrt(x*x+y*y+z*z)','nx')}, {r6('y/sqrt(x*x+y*y+z*z)','ny')}, {r6('z/sqrt(x*x+y*y+z*z)','nz')} FROM s""")
def _(t):
    return H.vertex_normals(_metrics(t)).select("scene_id", "vid", *[rounded(F.col(c), c) for c in ("nx", "ny", "nz")])


@query("r1_components", f"WITH RECURSIVE {PARTS} SELECT * FROM parts")
def _(t):
    return _parts(t)


@query("w2_rank_components", f"""WITH RECURSIVE {PARTS} SELECT scene_id, component, count(*) AS faces, row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, component) - 1 AS rank FROM parts GROUP BY 1, 2""")
def _(t):
    return H.rank_components(_parts(t))


@query("g15_drop_small", f"""WITH RECURSIVE {PARTS}, n AS (SELECT scene_id, component, count(*) AS n FROM parts GROUP BY 1, 2) SELECT scene_id, coalesce(sum(n) FILTER (n >= 80), 0)::BIGINT AS kept_faces, coalesce(sum(n) FILTER (n < 80), 0)::BIGINT AS removed_faces FROM n GROUP BY 1""")
def _(t):
    kept, removed = H.drop_small(t.faces_kept, _parts(t), 80)
    return removed.join(kept.groupBy("scene_id").agg(F.count("*").alias("kept_faces")), "scene_id", "left").na.fill(0, ["kept_faces"])


@query("g13_face_support", f"WITH {SUPPORT} SELECT f.scene_id, f.fid, count(s.view_id) AS views, count(s.view_id) = 0 AS completion FROM faces f LEFT JOIN sup s ON f.scene_id*1000+f.fid = s.scene_id*1000+s.fid GROUP BY 1, 2")
def _(t):
    support = H.face_support(t.faces, t.vertex_support)
    views = support.groupBy("scene_id", "fid").agg(F.count("*").alias("views"))
    return H.with_completion(t.faces, support).join(views, ["scene_id", "fid"], "left").select("scene_id", "fid", F.coalesce("views", F.lit(0)).alias("views"), "completion")


STATS = f"""{PARTS}, {TRI}, {SUPPORT}, ka AS (SELECT p.*, t.len/2 AS area FROM parts p JOIN tri t ON p.scene_id*1000+p.fid = t.scene_id*1000+t.fid),
seen AS (SELECT DISTINCT scene_id*1000+fid AS key FROM sup),
tot AS (SELECT scene_id, component, count(*) AS faces, sum(area) AS area, coalesce(sum(area) FILTER (s.key IS NOT NULL), 0) AS sup_area FROM ka LEFT JOIN seen s ON ka.scene_id*1000+ka.fid = s.key GROUP BY 1, 2),
pv AS (SELECT ka.scene_id, component, view_id, sum(area) AS va FROM ka JOIN sup s ON ka.scene_id*1000+ka.fid = s.scene_id*1000+s.fid GROUP BY 1, 2, 3),
strong AS (SELECT t.scene_id*1000+t.component AS key, count(*) AS n FROM tot t JOIN pv ON t.scene_id*1000+t.component = pv.scene_id*1000+pv.component WHERE va/greatest(area,1e-12) >= 0.1 GROUP BY 1),
stats AS (SELECT t.*, coalesce(n, 0) AS strong_views, first_value(area) OVER w AS main_area, row_number() OVER w AS rk FROM tot t LEFT JOIN strong s ON t.scene_id*1000+t.component = s.key WINDOW w AS (PARTITION BY scene_id ORDER BY faces DESC, component))"""


def _stats(t):
    support = H.face_support(t.faces, t.vertex_support)
    return H.component_stats(_parts(t), _metrics(t), support)


@query("g14_component_stats", f"""WITH RECURSIVE {STATS} SELECT scene_id, component, faces, {r6('area','area')}, {r6('sup_area/greatest(area,1e-12)','supported_fraction')}, strong_views, {r6('area/greatest(main_area,1e-12)','relative_area')}, rk = 1 AS is_main FROM stats""")
def _(t):
    return _stats(t).select("scene_id", "component", "faces", *[rounded(F.col(c), c) for c in ("area", "supported_fraction", "relative_area")], F.col("strong_views").cast("bigint").alias("strong_views"), "is_main")


@query("g14_view_area_fractions", f"""WITH RECURSIVE {STATS} SELECT pv.scene_id, pv.component, view_id, {r6('va/greatest(area,1e-12)','fraction')} FROM pv JOIN tot t ON t.scene_id*1000+t.component = pv.scene_id*1000+pv.component""")
def _(t):
    support = H.face_support(t.faces, t.vertex_support)
    return H.view_area_fractions(_parts(t), _metrics(t), support).withColumn("fraction", rounded(F.col("fraction"), "fraction"))


CUTOFF = 0.12
DIST = f"""{STATS}, pvx AS MATERIALIZED (SELECT DISTINCT p.scene_id, p.component, s.rk = 1 AS is_main, v.x, v.y, v.z FROM parts p JOIN stats s ON p.scene_id*1000+p.component = s.scene_id*1000+s.component JOIN faces f ON p.scene_id*1000+p.fid = f.scene_id*1000+f.fid
 JOIN vertices v ON f.scene_id = v.scene_id AND (v.vid = f.v0 OR v.vid = f.v1 OR v.vid = f.v2)),
dist AS (SELECT a.scene_id, a.component, min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))) AS d FROM pvx a JOIN pvx b ON a.scene_id = b.scene_id AND b.is_main AND NOT a.is_main GROUP BY 1, 2)"""


def _distance(t, parts=None, stats=None):
    parts = _parts(t) if parts is None else parts
    main = (H.rank_components(parts) if stats is None else stats).select("scene_id", "component", (F.col("rank") == 0 if stats is None else F.col("is_main")).alias("is_main"))
    used = t.faces.join(parts, ["scene_id", "fid"]).select("scene_id", "component", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return H.distance_to_main(used.join(t.vertices, ["scene_id", "vid"]).join(main, ["scene_id", "component"]), CUTOFF)


@query("j15_distance_to_main", f"""WITH RECURSIVE {DIST} SELECT s.scene_id, s.component, {r6(f'CASE WHEN s.rk = 1 THEN 0 WHEN d <= {CUTOFF} THEN d END','distance')} FROM stats s LEFT JOIN dist d ON s.scene_id*1000+s.component = d.scene_id*1000+d.component""")
def _(t):
    return _distance(t).select("scene_id", "component", rounded(F.col("distance"), "distance"))


@query("f59_retain_components", f"""WITH RECURSIVE {DIST}, j AS (SELECT s.*, CASE WHEN s.rk = 1 THEN 0 WHEN d <= {CUTOFF} THEN d END AS dd, sup_area/greatest(area,1e-12) AS sf FROM stats s LEFT JOIN dist d ON s.scene_id*1000+s.component = d.scene_id*1000+d.component)
SELECT scene_id, component, CASE WHEN rk = 1 THEN 'main' WHEN coalesce(dd <= 0.008*5, false) AND sf >= 0.6 THEN 'nearby-depth-supported' WHEN area >= main_area*0.01 AND coalesce(dd <= 1.2*0.1, false) AND sf >= 0.9 AND strong_views >= 2 THEN 'substantial-multiview-part' ELSE 'unsupported-or-detached-dust' END AS reason FROM j""")
def _(t):
    parts = _parts(t)
    stats = H.component_stats(parts, _metrics(t), H.face_support(t.faces, t.vertex_support))
    d = _distance(t, parts, stats).select("scene_id", "component", "distance")
    joined = stats.join(d, ["scene_id", "component"]).withColumns({"rank": F.when(F.col("is_main"), 0).otherwise(1), "spacing": F.lit(0.008), "main_extent": F.lit(1.2)})
    return R.retain_components(joined).select("scene_id", "component", "reason")


@query("w10_compact_mesh", """WITH u AS (SELECT scene_id, vid, row_number() OVER (PARTITION BY scene_id ORDER BY vid) - 1 AS new_vid FROM (SELECT scene_id, v0 AS vid FROM faces_kept UNION SELECT scene_id, v1 FROM faces_kept UNION SELECT scene_id, v2 FROM faces_kept))
SELECT f.scene_id, row_number() OVER (PARTITION BY f.scene_id ORDER BY fid) - 1 AS new_fid, a.new_vid AS n0, b.new_vid AS n1, c.new_vid AS n2 FROM faces_kept f JOIN u a ON f.scene_id*1000+f.v0 = a.scene_id*1000+a.vid JOIN u b ON f.scene_id*1000+f.v1 = b.scene_id*1000+b.vid JOIN u c ON f.scene_id*1000+f.v2 = c.scene_id*1000+c.vid""")
def _(t):
    faces, _ = H.compact_mesh(t.faces_kept, t.vertices, 128)
    return faces.select("scene_id", "new_fid", "n0", "n1", "n2")


def _taubin_sql():
    head = "ways AS MATERIALIZED (SELECT scene_id*1000+va AS p, scene_id*1000+vb AS q FROM (SELECT DISTINCT scene_id, va, vb FROM half_edges) UNION ALL SELECT scene_id*1000+vb, scene_id*1000+va FROM (SELECT DISTINCT scene_id, va, vb FROM half_edges)), s0 AS (SELECT scene_id*1000+vid AS p, x, y, z FROM vertices)"
    for i, f in enumerate((0.5, -0.53, 0.5)):
        head += f", s{i+1} AS MATERIALIZED (SELECT v.p, {', '.join(f'v.{a}+coalesce(m.{a}-v.{a},0)*{f} AS {a}' for a in 'xyz')} FROM s{i} v LEFT JOIN (SELECT w.p, {', '.join(f'CAST(sum(CAST(round({a}*1e12) AS HUGEINT)) AS DOUBLE)/count(*)/1e12 AS {a}' for a in 'xyz')} FROM ways w JOIN s{i} o ON w.q = o.p GROUP BY w.p) m ON v.p = m.p)"
    return f"WITH {head} SELECT p // 1000 AS scene_id, p % 1000 AS vid, {r6('x','x')}, {r6('y','y')}, {r6('z','z')} FROM s3"


@query("r4_taubin", _taubin_sql())
def _(t):
    return H.taubin(t.vertices, H.face_edges(t.faces)).select("scene_id", "vid", *[rounded(F.col(a), a) for a in "xyz"])


@query("f23_uv_area", f"SELECT scene_id, fid, {r6('s','uv_signed')}, {r6('abs(s)','uv_area')}, abs(s) <= 1e-15 AS degenerate FROM (SELECT *, (ub-ua)*(vc-va)-(vb-va)*(uc-ua) AS s FROM uv_corners)")
def _(t):
    return H.uv_areas(t.uv_corners).select("scene_id", "fid", rounded(F.col("uv_signed"), "uv_signed"), rounded(F.col("uv_area"), "uv_area"), "degenerate")


@query("u3_split_by_class", "SELECT scene_id, count(*) FILTER (NOT completion) AS learned, count(*) FILTER (completion) AS completed, count(*) AS total FROM faces GROUP BY 1")
def _(t):
    learned, done = H.split_by_class(t.faces)
    a = learned.groupBy("scene_id").agg(F.count("*").alias("learned"))
    b = done.groupBy("scene_id").agg(F.count("*").alias("completed"))
    both = learned.unionByName(done).groupBy("scene_id").agg(F.count("*").alias("total"))
    return both.join(a, "scene_id", "left").join(b, "scene_id", "left").na.fill(0)


@query("u7_same_mesh", "SELECT 0::BIGINT AS only_first, count(*) AS only_second, count(*) = 0 AS same FROM faces WHERE fid % 2 = 1 AND scene_id % 2 = 1")
def _(t):
    return L.same_table(t.faces.where("NOT (fid % 2 = 1 AND scene_id % 2 = 1)"), t.faces)


def _numbered(t):
    return t.points, ["view_id", "point_id"], F.struct("view_id", F.floor(F.col("point_id") / 10**8))


@query("t4_thin_evenly", """WITH n AS (SELECT scene_id, view_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY view_id, point_id) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points)
SELECT scene_id, point_id, k AS row_index FROM n WHERE n <= 100 OR list_contains(list_transform(range(100), lambda i: i*(n-1)//99), k)""")
def _(t):
    df, order, bucket = _numbered(t)
    return K.thin_evenly(df, order, bucket, 100, ["scene_id"]).select("scene_id", "point_id", "row_index")


@query("t4_thin_stride", """WITH n AS (SELECT scene_id, view_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY view_id, point_id) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points)
SELECT scene_id, point_id, k AS row_index FROM n WHERE k % greatest(1, n // 120) = 0""")
def _(t):
    df, order, bucket = _numbered(t)
    return K.thin_stride(df, order, bucket, 120, ["scene_id"]).select("scene_id", "point_id", "row_index")


@query("t5_probe_rows", """WITH n AS (SELECT scene_id, view_id, point_id, row_number() OVER (PARTITION BY scene_id ORDER BY view_id, point_id) - 1 AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM points)
SELECT scene_id, point_id, k AS row_index FROM n WHERE k IN (0, n // 2, n - 1)""")
def _(t):
    df, order, bucket = _numbered(t)
    return K.probe_rows(df, order, bucket, ["scene_id"]).select("scene_id", "point_id", "row_index")


@query("t6_stable_order", "SELECT path, name, arrival FROM files ORDER BY path, arrival")
def _(t):
    return t.files.select("path", "name", "arrival").orderBy("path", "arrival")
