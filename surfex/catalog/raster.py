"""Raster, visibility, silhouettes and masks."""

from pyspark.sql import functions as F

from ..functions import matrices as M
from ..operators import gather as G
from ..operators import masks as S
from ..operators import mesh as H
from ..operators import raster as Z
from . import bindings  # noqa: F401
from .geometry import BACK, MASK, SEEN, _back, _seen, rounded
from .mesh import TRI
from .registry import bind, query
from .text import camera, pixel, r6


def raster_sql(src, keys, w, h, name):
    """CTEs that rasterise ``src`` (px0.. pz2) into ``name``."""
    k = ", ".join(keys)
    return f"""{name}_b AS MATERIALIZED (SELECT {k}, fid, den, px0, py0, pz0, px1, py1, pz1, px2, py2, pz2, xlo, xhi, unnest(generate_series(ylo, yhi)) AS y FROM (
 SELECT *, (py1-py2)*(px0-px2)+(px2-px1)*(py0-py2) AS den, greatest(ceil(least(px0,px1,px2)), 0)::INT AS xlo, least(floor(greatest(px0,px1,px2)), {w}-1)::INT AS xhi,
 greatest(ceil(least(py0,py1,py2)), 0)::INT AS ylo, least(floor(greatest(py0,py1,py2)), {h}-1)::INT AS yhi FROM {src} WHERE pz0 > 0 AND pz1 > 0 AND pz2 > 0) WHERE abs(den) >= 1e-10 AND xlo <= xhi AND ylo <= yhi),
{name}_c AS (SELECT *, unnest(generate_series(xlo, xhi)) AS x FROM {name}_b),
{name}_h AS (SELECT *, u/pz0+v/pz1+(1-u-v)/pz2 AS inv FROM (SELECT *, ((py1-py2)*(x-px2)+(px2-px1)*(y-py2))/den AS u, ((py2-py0)*(x-px2)+(px0-px2)*(y-py2))/den AS v FROM {name}_c) WHERE u >= -1e-7 AND v >= -1e-7 AND 1-u-v >= -1e-7),
{name} AS MATERIALIZED (SELECT {k}, x::INT AS x, y::INT AS y, m.z AS z, m.fid AS fid, m.b0 AS b0, m.b1 AS b1 FROM (SELECT {k}, x, y, min({{'z': 1/inv, 'fid': fid, 'b0': u/pz0/inv, 'b1': v/pz1/inv}}) AS m FROM {name}_h GROUP BY ALL))"""


VIEW_TRI = ("vt0 AS (SELECT c.*, m.view_id, m.ext, m.k, m.w, m.h FROM corners c JOIN cameras m ON c.scene_id = m.scene_id), "
            "vt1 AS (SELECT *, " + ", ".join(camera(f"x{i}", f"y{i}", f"z{i}", str(i)) for i in range(3)) + " FROM vt0), "
            "vt AS (SELECT scene_id, view_id, fid, w, h, " + ", ".join(pixel(str(i)).replace(f"AS u{i}", f"AS px{i}").replace(f"AS v{i}", f"AS py{i}") + f", cz{i} AS pz{i}" for i in range(3)) + " FROM vt1)")
VIEW_RASTER = f"{VIEW_TRI}, {raster_sql('vt', ['scene_id', 'view_id'], 'w', 'h', 'zb')}"
ATLAS_W, ATLAS_H = 256, 64
ATLAS = "att AS (SELECT scene_id, fid, " + ", ".join(f"u{n}*{ATLAS_W}-0.5 AS px{i}, (1-v{n})*{ATLAS_H}-0.5 AS py{i}, 1.0::DOUBLE AS pz{i}" for i, n in enumerate("abc")) + f" FROM uv_corners), {raster_sql('att', ['scene_id'], ATLAS_W, ATLAS_H, 'tx')}"


def _zbuffer(t):
    return Z.view_zbuffer(t.corners, t.cameras)


def _atlas(t, faces=None, carry=()):
    return Z.atlas_raster(t.uv_corners if faces is None else faces, ATLAS_W, ATLAS_H, carry)


@query("g7_view_zbuffer", f"WITH {VIEW_RASTER} SELECT scene_id, view_id, x, y, fid, {r6('z','z')}, {r6('b0','b0')}, {r6('b1','b1')} FROM zb")
def _(t):
    return _zbuffer(t).select("scene_id", "view_id", "x", "y", "fid", *[rounded(F.col(c), c) for c in ("z", "b0", "b1")])


@query("g7_atlas_raster", f"WITH {ATLAS} SELECT scene_id, x, y, fid, {r6('b0','b0')}, {r6('b1','b1')} FROM tx")
def _(t):
    return _atlas(t).select("scene_id", "x", "y", "fid", *[rounded(F.col(c), c) for c in ("b0", "b1")])


SURFACE = "sp AS (SELECT t.scene_id, t.x AS tx, t.y AS ty, t.fid, " + ", ".join(f"b0*c.{a}0+b1*c.{a}1+(1-(b0+b1))*c.{a}2 AS {a}" for a in "xyz") + " FROM tx t JOIN corners c ON t.scene_id*1000+t.fid = c.scene_id*1000+c.fid)"


@query("f22_surface_points", f"WITH {ATLAS}, {SURFACE} SELECT scene_id, tx, ty, {r6('x','x')}, {r6('y','y')}, {r6('z','z')} FROM sp")
def _(t):
    return Z.surface_points(_atlas(t), t.corners).select("scene_id", "tx", "ty", *[rounded(F.col(a), a) for a in "xyz"])


bind("mask_distances", "SELECT scene_id, view_id, x, y, CASE WHEN mask THEN confidence ELSE 0e0 END AS distance, CASE WHEN mask AND label <> 1 THEN 255e0 ELSE 100e0 END AS level FROM pixels")

CENTRES = f"""{TRI}, ctr AS (SELECT t.scene_id, t.fid, px/len AS nx, py/len AS ny, pz/len AS nz, len/2 AS area, mx AS x, my AS y, mz AS z FROM tri t),
cv0 AS (SELECT c.*, m.view_id, m.ext, m.k, m.w, m.h, {camera('c.x','c.y','c.z')} FROM ctr c JOIN cameras m ON c.scene_id = m.scene_id), cv AS (SELECT *, {pixel()} FROM cv0),
cp AS (SELECT *, least(greatest(round_even(u,0),0),w-1)::BIGINT AS qx, least(greatest(round_even(v,0),0),h-1)::BIGINT AS qy FROM cv),
vis AS MATERIALIZED (SELECT cp.*, coalesce(d.distance, 0) AS md, abs(cz - zb.z) AS gap, coalesce(d.level, 0) AS level,
 coalesce(cz > 0 AND u >= 1 AND u < w-2 AND v >= 1 AND v < h-2 AND coalesce(d.distance,0) > 0 AND abs(cz-zb.z) < 0.0025 + cz/k[1]*1.5 AND coalesce(d.level,0) >= 254, false) AS valid
 FROM cp LEFT JOIN zb ON ((cp.scene_id*5+cp.view_id)*30+qy)*40+qx = ((zb.scene_id*5+zb.view_id)*30+zb.y)*40+zb.x LEFT JOIN mask_distances d ON ((cp.scene_id*5+cp.view_id)*30+qy)*40+qx = ((d.scene_id*5+d.view_id)*30+d.y)*40+d.x)"""


def _centres(t, photos=None):
    m = H.face_metrics(t.corners).select("scene_id", "fid", "area", "nx", "ny", "nz", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    return G.in_views(m, t.cameras, ("ext", "k", "w", "h"), photos=photos, deal=F.col("fid")).withColumn("fx", F.col("k")[0])


def _visible(t):
    zbuffer = _zbuffer(t)
    photos = Z.visibility_pictures(t.cameras, zbuffer, t.mask_distances, ("level",))
    return Z.visible(_centres(t, photos), zbuffer, t.mask_distances, 0.0025, t.mask_distances)


@query("f37_visible", f"WITH {VIEW_RASTER}, {CENTRES} SELECT scene_id, fid, view_id, valid, {r6('md','mask_distance')} FROM vis")
def _(t):
    return _visible(t).select("scene_id", "fid", "view_id", "valid", rounded(F.col("mask_distance"), "mask_distance"))


@query("j17_region_faces", f"WITH {VIEW_RASTER} SELECT DISTINCT z.scene_id, region_id, fid FROM zb z JOIN regions r ON z.scene_id*5+z.view_id = r.scene_id*5+r.view_id AND z.x >= x0 AND z.x < x1 AND z.y >= y0 AND z.y < y1")
def _(t):
    return Z.region_faces(_zbuffer(t), t.regions)


PSEEN = f"ps AS (SELECT *, {pixel()} FROM (SELECT p.scene_id, p.view_id AS source_view, p.point_id*10+p.view_id AS point_id, p.r, c.view_id, c.ext, c.k, c.w, c.h, {camera('p.x','p.y','p.z')} FROM points p JOIN cameras c ON p.scene_id = c.scene_id)), pi AS (SELECT *, round_even(u,0)::INT AS x, round_even(v,0)::INT AS y FROM ps WHERE cz > 0 AND round_even(u,0) BETWEEN 0 AND w-1 AND round_even(v,0) BETWEEN 0 AND h-1)"


def _pseen(t):
    p = t.points.select("scene_id", F.col("view_id").alias("source_view"), (F.col("point_id") * 10 + F.col("view_id")).alias("point_id"), "x", "y", "z", "r")
    return G.in_views(p, t.cameras, ("w", "h"))


@query("g8_point_splat", f"WITH {PSEEN} SELECT scene_id, view_id, x, y, m.p AS point_id, m.r AS r, {r6('m.z','z')} FROM (SELECT scene_id, view_id, x, y, min({{'z': cz, 'p': point_id, 'r': r}}) AS m FROM pi GROUP BY ALL)")
def _(t):
    return Z.splat(_pseen(t), ["r"]).select("scene_id", "view_id", "x", "y", "point_id", "r", rounded(F.col("z"), "z"))


IOU = "SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.view_id, b.view_id) AS view_id, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS common, count(*) FILTER (b.x IS NULL) AS extra, count(*) FILTER (a.x IS NULL) AS missing, round(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL)/greatest(count(*),1)::DOUBLE, 6) AS iou FROM {a} a FULL JOIN {b} b ON ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x = ((b.scene_id*5+b.view_id)*30+b.y)*40+b.x GROUP BY 1, 2"


@query("g9_silhouette_iou", "WITH ma AS (SELECT * FROM pixels WHERE mask), mb AS (SELECT * FROM pixels_b WHERE mask) " + IOU.format(a="ma", b="mb"))
def _(t):
    return S.compare_masks(t.pixels.where("mask"), t.pixels_b.where("mask")).withColumn("iou", F.round("iou", 6))


def close_sql(src, out):
    o = "(SELECT unnest(generate_series(-1, 1)) AS dx) a, (SELECT unnest(generate_series(-1, 1)) AS dy) b"
    return f"""{out}_d AS (SELECT DISTINCT scene_id, view_id, x+dx AS x, y+dy AS y FROM {src}, {o} WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29),
{out}_n AS (SELECT scene_id, view_id, x+dx AS x, y+dy AS y, count(*) AS n FROM {out}_d, {o} WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29 GROUP BY 1,2,3,4),
{out} AS MATERIALIZED (SELECT scene_id, view_id, x, y FROM {out}_n WHERE n = (CASE WHEN x IN (0,39) THEN 2 ELSE 3 END) * (CASE WHEN y IN (0,29) THEN 2 ELSE 3 END))"""


@query("g10_leave_one_out_iou", f"WITH {PSEEN}, hit AS (SELECT DISTINCT scene_id, view_id, x, y FROM pi WHERE source_view <> view_id), {close_sql('hit', 'sil')}, mb AS (SELECT * FROM pixels WHERE mask), v AS ({IOU.format(a='sil', b='mb')}), e AS (SELECT scene_id, view_id, common/greatest(common+extra+missing,1)::DOUBLE AS iou FROM v) SELECT scene_id, round(avg(iou), 6) AS mean_iou FROM e GROUP BY 1")
def _(t):
    return S.leave_one_out(_pseen(t), t.pixels.where("mask"), t.cameras)[1].withColumn("mean_iou", F.round("mean_iou", 6))


@query("g30_mask_agreement", "WITH ma AS (SELECT * FROM pixels WHERE mask), mb AS (SELECT * FROM pixels_b WHERE mask), v AS (" + IOU.format(a="ma", b="mb") + ") SELECT scene_id, view_id, round(common/(common+extra+missing)::DOUBLE, 6) AS agreement FROM v")
def _(t):
    return S.compare_masks(t.pixels.where("mask"), t.pixels_b.where("mask")).select("scene_id", "view_id", F.round("iou", 6).alias("agreement"))


@query("g11_pick_instance", f"""WITH s AS (SELECT scene_id, view_id, label, sum(exp(-(((x+0.5)/40-0.5)*((x+0.5)/40-0.5)+((y+0.5)/30-0.5)*((y+0.5)/30-0.5))/0.08::DOUBLE)) AS score, count(*) AS pixels FROM pixels WHERE label > 0 GROUP BY 1,2,3)
SELECT scene_id, view_id, label, {r6('score','score')}, pixels, count(*) OVER (PARTITION BY scene_id, view_id) AS candidates FROM s QUALIFY row_number() OVER (PARTITION BY scene_id, view_id ORDER BY score DESC, label) = 1""")
def _(t):
    return S.pick_instance(t.pixels, 40, 30).withColumn("score", rounded(F.col("score"), "score"))


@query("g12_pick_instance_strip", "WITH s AS (SELECT scene_id, view_id, label, count(*) AS pixels FROM pixels WHERE label > 0 AND x BETWEEN 16 AND 23 AND y BETWEEN 7 AND 24 GROUP BY 1,2,3) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scene_id, view_id ORDER BY pixels DESC, label) = 1")
def _(t):
    return S.pick_instance_strip(t.pixels, 40, 30)


@query("u5_mask_algebra", "SELECT a.scene_id, a.view_id, count(*) FILTER (b.x IS NOT NULL) AS both_masks, count(*) FILTER (b.x IS NULL) AS only_first FROM (SELECT * FROM pixels WHERE mask) a LEFT JOIN (SELECT * FROM pixels_b WHERE mask) b ON ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x = ((b.scene_id*5+b.view_id)*30+b.y)*40+b.x GROUP BY 1, 2")
def _(t):
    a, b = t.pixels.where("mask"), t.pixels_b.where("mask")
    keys = ["scene_id", "view_id"]
    return S.mask_and(a, b).groupBy(*keys).agg(F.count("*").alias("both_masks")).join(
        S.mask_minus(a, b).groupBy(*keys).agg(F.count("*").alias("only_first")), keys, "full_outer").na.fill(0)


@query("u5_mask_min", "SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.view_id, b.view_id) AS view_id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(least(nullif(a.r, NULL), CASE WHEN a.r IS NULL THEN NULL ELSE b.r END) * CASE WHEN a.r IS NULL OR b.r IS NULL THEN 0 ELSE 1 END, 0) AS level FROM pixels a FULL JOIN pixels_b b ON ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x = ((b.scene_id*5+b.view_id)*30+b.y)*40+b.x")
def _(t):
    return S.mask_min(t.pixels.withColumn("level", F.col("r")), t.pixels_b.withColumn("level", F.col("r")))


POLY = "[{'x': 5.0, 'y': 3.0}, {'x': 33.0, 'y': 6.0}, {'x': 28.0, 'y': 25.0}, {'x': 20.0, 'y': 12.0}, {'x': 8.0, 'y': 22.0}]"


@query("f28_in_polygon", "WITH e AS (SELECT * FROM (VALUES (5.0,3.0,33.0,6.0),(33.0,6.0,28.0,25.0),(28.0,25.0,20.0,12.0),(20.0,12.0,8.0,22.0),(8.0,22.0,5.0,3.0)) v(ax,ay,bx,by_)) SELECT scene_id, view_id, x, y, count(*) FILTER ((ay > y) <> (by_ > y) AND x < ax + (bx-ax)*(y-ay)/nullif(by_-ay,0)::DOUBLE) % 2 = 1 AS inside FROM pixels, e GROUP BY 1,2,3,4")
def _(t):
    pts = ((5.0, 3.0), (33.0, 6.0), (28.0, 25.0), (20.0, 12.0), (8.0, 22.0))
    poly = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pts])
    return t.pixels.select("scene_id", "view_id", "x", "y", M.in_polygon(F.col("x"), F.col("y"), poly).alias("inside"))


BOXES = "boxes AS (SELECT scene_id, view_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM regions GROUP BY 1, 2)"


def _boxes(t):
    return t.regions.groupBy("scene_id", "view_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


SKY = f"{BOXES}, sky AS (SELECT p.* FROM pixels p JOIN boxes b ON p.scene_id*5+p.view_id = b.scene_id*5+b.view_id WHERE p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 AND b > r*1.25 AND p.b > g*1.08 AND p.b - r > 25)".replace(" AND b > r", " AND p.b > r").replace("JOIN boxes b ON", "JOIN boxes q ON").replace("= b.scene_id*5+b.view_id", "= q.scene_id*5+q.view_id")


@query("f41_sky_pixels", f"WITH {SKY} SELECT scene_id, view_id, x, y FROM sky")
def _(t):
    return S.sky_pixels(t.pixels, _boxes(t))


@query("g24_mask_revision", f"""WITH {SKY}, c AS (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.view_id, b.view_id) AS view_id, a.x IS NOT NULL AS bef, b.x IS NOT NULL AS aft, s.x IS NOT NULL AS sk FROM (SELECT * FROM pixels WHERE mask) a
 FULL JOIN (SELECT * FROM pixels_b WHERE mask) b ON ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x = ((b.scene_id*5+b.view_id)*30+b.y)*40+b.x LEFT JOIN sky s ON ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x = ((s.scene_id*5+s.view_id)*30+s.y)*40+s.x),
n AS (SELECT scene_id*5+view_id AS key, count(*) AS polygons FROM regions GROUP BY 1)
SELECT scene_id, view_id, count(*) FILTER (bef) AS before, count(*) FILTER (aft) AS after, count(*) FILTER (bef AND NOT aft) AS removed, count(*) FILTER (bef AND sk) AS sky_removed, any_value(coalesce(polygons, 0)) AS polygons FROM c LEFT JOIN n ON scene_id*5+view_id = key GROUP BY 1, 2""")
def _(t):
    lv = F.when(F.col("mask"), 255).otherwise(0)
    return S.mask_revision_report(t.pixels.withColumn("level", lv), t.pixels_b.withColumn("level", lv), S.sky_pixels(t.pixels, _boxes(t)), t.regions)


@query("g25_mask_audit", """WITH m AS (SELECT scene_id, view_id, x, y FROM pixels WHERE mask), b AS (SELECT scene_id, view_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS bt FROM m GROUP BY 1, 2),
n AS (SELECT m.*, l, r, t, bt, y < t + (bt-t)*0.65 AS up FROM m JOIN b ON m.scene_id*5+m.view_id = b.scene_id*5+b.view_id), rx AS (SELECT *, max(x) FILTER (up) OVER (PARTITION BY scene_id, view_id) AS right_x FROM n),
g AS (SELECT scene_id, view_id, any_value(l) AS "left", any_value(r) AS "right", any_value(t) AS top, any_value(bt) AS bottom, any_value(right_x) AS right_x, trunc(median(x) FILTER (y < t+8))::INT AS top_x, trunc(median(x) FILTER (y > bt-8))::INT AS bottom_x, trunc(median(y) FILTER (up AND x > right_x-4))::INT AS right_y FROM rx GROUP BY 1, 2)
SELECT *, least(greatest(top_x-8,0),24) AS crop_a_x, least(greatest(top+20-8,0),14) AS crop_a_y, least(greatest(right_x-20-8,0),24) AS crop_b_x, least(greatest(right_y-8,0),14) AS crop_b_y, least(greatest(bottom_x-8,0),24) AS crop_c_x, least(greatest(bottom-20-8,0),14) AS crop_c_y FROM g""")
def _(t):
    return S.mask_audit(t.pixels.where("mask"), F.lit(40), F.lit(30), 8, 16)


@query("g32_confidence_cut", f"WITH v AS (SELECT * FROM pixels WHERE mask AND depth > 0), q AS (SELECT scene_id*5+view_id AS key, quantile_cont(confidence, 0.1) AS threshold FROM v GROUP BY 1) SELECT scene_id, view_id, x, y, {r6('threshold','threshold')} FROM v JOIN q ON scene_id*5+view_id = key WHERE confidence >= threshold")
def _(t):
    return S.confidence_cut(t.pixels).select("scene_id", "view_id", "x", "y", rounded(F.col("threshold"), "threshold"))


@query("f27_grid_faces", """WITH v AS MATERIALIZED (SELECT *, ((scene_id*5+view_id)*100+y)*100+x AS key FROM pixels WHERE mask), md AS (SELECT scene_id*5+view_id AS vk, median(depth) AS med FROM v GROUP BY 1),
t AS (SELECT a.scene_id, a.view_id, a.x, a.y, 0 AS side, greatest(a.depth, b.depth, c.depth) AS far, least(a.depth, b.depth, c.depth) AS near FROM v a JOIN v b ON a.key+1 = b.key JOIN v c ON a.key+100 = c.key UNION ALL
 SELECT b.scene_id, b.view_id, b.x-1, b.y, 1, greatest(b.depth, c.depth, d.depth), least(b.depth, c.depth, d.depth) FROM v b JOIN v c ON b.key+99 = c.key JOIN v d ON b.key+100 = d.key WHERE b.x > 0)
SELECT scene_id, view_id, x, y, side, far, near FROM t JOIN md ON scene_id*5+view_id = vk WHERE far - near < med*0.01""")
def _(t):
    return S.grid_faces(t.pixels.where("mask"), 0.01)
