"""Cameras, pixel maps, projections and gathers."""

from pyspark.sql import functions as F

from ..functions import matrices as M
from ..operators import gather as G
from ..operators import grids as R
from ..operators import mesh as H
from . import bindings  # noqa: F401
from .registry import query
from .text import camera, pixel, r6

R9 = range(9)


def rounded(col, name):
    return (F.round(col, 6) + F.lit(0.0)).alias(name)


def arr_sql(a, name, n=9):
    return ", ".join(r6(f"{a}[{i + 1}]", f"{name}{i}") for i in range(n))


def arr_cols(col, name, n=9):
    return [rounded(col[i], f"{name}{i}") for i in range(n)]


def mul_sql(a, b):
    return "[" + ", ".join(f"{a}[{3*i+1}]*{b}[{j+1}]+{a}[{3*i+2}]*{b}[{j+4}]+{a}[{3*i+3}]*{b}[{j+7}]" for i in range(3) for j in range(3)) + "]"


ORIENT = """CASE orientation WHEN 1 THEN [1,0,0,0,1,0,0,0,1] WHEN 2 THEN [-1,0,w-1,0,1,0,0,0,1] WHEN 3 THEN [-1,0,w-1,0,-1,h-1,0,0,1]
 WHEN 4 THEN [1,0,0,0,-1,h-1,0,0,1] WHEN 5 THEN [0,1,0,1,0,0,0,0,1] WHEN 6 THEN [0,-1,h-1,1,0,0,0,0,1] WHEN 7 THEN [0,-1,h-1,-1,0,w-1,0,0,1]
 WHEN 8 THEN [0,1,0,-1,0,w-1,0,0,1] END::DOUBLE[]"""
SIZED = f"SELECT photo_id, orientation, w, h, {ORIENT} AS m FROM (SELECT *, pixel_width AS w, pixel_height AS h FROM photos)"
LETTER = """SELECT *, [nw/w::DOUBLE, 0, lf+(nw/w::DOUBLE-1)/2, 0, nh/h::DOUBLE, tp+(nh/h::DOUBLE-1)/2, 0, 0, 1]::DOUBLE[] AS tr FROM (
 SELECT *, floor((518-nw)/2) AS lf, floor((518-nh)/2) AS tp FROM (SELECT *, round_even(w*(518/greatest(w,h)::DOUBLE), 0) AS nw, round_even(h*(518/greatest(w,h)::DOUBLE), 0) AS nh FROM sized))"""


def _sized(t):
    w, h = F.col("pixel_width"), F.col("pixel_height")
    return t.photos.select("photo_id", "orientation", w.alias("w"), h.alias("h"), M.orientation_matrix(w, h, F.col("orientation")).alias("m"))


@query("f10_orientation_matrix", f"WITH sized AS ({SIZED}) SELECT photo_id, {', '.join(f'm[{i+1}] AS m{i}' for i in R9)} FROM sized")
def _(t):
    return _sized(t).select("photo_id", *[F.col("m")[i].alias(f"m{i}") for i in R9])


@query("f11_working_transform", f"""WITH sized AS ({SIZED}), s AS (SELECT *, 1600/greatest(w,h)::DOUBLE AS sx, round(1600/greatest(w,h)::DOUBLE*h)/h AS sy FROM sized)
SELECT photo_id, {arr_sql('[m[1]*sx, m[2]*sx, m[3]*sx+(sx-1)/2, m[4]*sy, m[5]*sy, m[6]*sy+(sy-1)/2]', 't', 6)} FROM s""")
def _(t):
    s = F.lit(1600.0) / F.greatest("w", "h")
    d = _sized(t).withColumn("sx", s).withColumn("sy", F.round(s * F.col("h")) / F.col("h"))
    return d.select("photo_id", *arr_cols(M.working_transform(F.col("m"), F.col("sx"), F.col("sy")), "t", 6))


@query("f12_letterbox", f"""WITH sized AS ({SIZED}), l AS ({LETTER}) SELECT photo_id, CAST(nw AS INT) AS width, CAST(nh AS INT) AS height, CAST(lf AS INT) AS padding_left, CAST(tp AS INT) AS padding_top,
 {arr_sql('c', 'c')} FROM (SELECT *, {mul_sql('tr', 'm')} AS c FROM l)""")
def _(t):
    d = _sized(t).withColumn("l", M.letterbox(F.col("w"), F.col("h"), 518))
    d = d.withColumn("c", M.matmul3(F.col("l.transform"), F.col("m")))
    return d.select("photo_id", F.col("l.width").alias("width"), F.col("l.height").alias("height"), F.col("l.left").alias("padding_left"),
                    F.col("l.top").alias("padding_top"), *arr_cols(F.col("c"), "c"))


@query("f13_full_intrinsics", """WITH sized AS (SELECT photo_id, pixel_width AS fw, pixel_height AS fh, least(pixel_width, 1600) AS w, least(pixel_height, 1200) AS h FROM photos),
l AS (""" + LETTER + f"""), m AS (SELECT *, {mul_sql('tr', 'ftw')} AS a FROM (SELECT *, [w/fw::DOUBLE,0,(w/fw::DOUBLE-1)/2,0,h/fh::DOUBLE,(h/fh::DOUBLE-1)/2,0,0,1]::DOUBLE[] AS ftw FROM l)),
i AS (SELECT *, [a[5]/d, -a[2]/d, (a[2]*a[6]-a[3]*a[5])/d, -a[4]/d, a[1]/d, (a[3]*a[4]-a[1]*a[6])/d, 0, 0, 1]::DOUBLE[] AS inv FROM (SELECT *, a[1]*a[5]-a[2]*a[4] AS d FROM m)),
k AS (SELECT *, [370,0,259,0,369,259,0,0,1]::DOUBLE[] AS k0 FROM i) SELECT photo_id, {arr_sql(mul_sql('inv', 'k0'), 'k')} FROM k""")
def _(t):
    w, h = F.least("pixel_width", F.lit(1600)), F.least("pixel_height", F.lit(1200))
    k = M.vector(370, 0, 259, 0, 369, 259, 0, 0, 1)
    full = M.full_intrinsics(k, M.letterbox(w, h, 518)["transform"], w, h, F.col("pixel_width"), F.col("pixel_height"))
    return t.photos.select("photo_id", full.alias("f")).select("photo_id", *arr_cols(F.col("f"), "k"))


@query("f14_resize_intrinsics", f"""WITH c AS (SELECT scene_id, view_id, k, [s,0,(s-1)/2,0,s,(s-1)/2,0,0,1]::DOUBLE[] AS r FROM (SELECT *, 1 + view_id/4::DOUBLE AS s FROM cameras))
SELECT scene_id, view_id, {arr_sql(mul_sql('r', 'k'), 'k')} FROM c""")
def _(t):
    s = F.lit(1.0) + F.col("view_id") / 4
    return t.cameras.select("scene_id", "view_id", *arr_cols(M.resize_intrinsics(F.col("k"), s), "k"))


SEEN = f"""seen AS (SELECT *, {pixel()} FROM (SELECT v.scene_id, v.vid, v.x, v.y, v.z, c.view_id, c.ext, c.k, c.w, c.h, {camera('v.x','v.y','v.z')} FROM vertices v JOIN cameras c ON v.scene_id = c.scene_id))"""


def _seen(t, keep=("w", "h"), photos=None):
    return G.in_views(t.vertices, t.cameras, keep, photos=photos, deal=F.col("vid"))


@query("f15_project", f"WITH {SEEN} SELECT scene_id, vid, view_id, {r6('u','u')}, {r6('v','v')}, {r6('cz','z_cam')} FROM seen")
def _(t):
    return _seen(t).select("scene_id", "vid", "view_id", rounded(F.col("u"), "u"), rounded(F.col("v"), "v"), rounded(F.col("z_cam"), "z_cam"))


@query("j5_points_in_views", f"WITH {SEEN} SELECT scene_id, view_id, count(*) AS points, count(*) FILTER (cz > 0) AS ahead FROM seen GROUP BY 1, 2")
def _(t):
    return _seen(t).groupBy("scene_id", "view_id").agg(F.count("*").alias("points"), F.count_if(F.col("z_cam") > 0).alias("ahead"))


BACK = """back AS (SELECT scene_id, view_id, px, py, mask, confidence, ax*ext[1]+ay*ext[5]+az*ext[9] AS x, ax*ext[2]+ay*ext[6]+az*ext[10] AS y, ax*ext[3]+ay*ext[7]+az*ext[11] AS z FROM (
 SELECT p.*, p.x AS px, p.y AS py, c.ext, (p.x-c.k[3])/c.k[1]*depth - c.ext[4] AS ax, (p.y-c.k[6])/c.k[5]*depth - c.ext[8] AS ay, depth - c.ext[12] AS az FROM pixels p JOIN cameras c ON p.scene_id*5+p.view_id = c.scene_id*5+c.view_id))"""


def _back(t):
    cams = t.cameras.select("scene_id", "view_id", "ext", "k")
    world = M.backproject(F.col("x"), F.col("y"), F.col("depth"), F.col("ext"), F.col("k"))
    return t.pixels.join(cams, ["scene_id", "view_id"]).withColumn("w", world)


@query("f16_backproject", f"WITH {BACK} SELECT scene_id, view_id, px, py, {r6('x','x')}, {r6('y','y')}, {r6('z','z')} FROM back")
def _(t):
    return _back(t).select("scene_id", "view_id", F.col("x").alias("px"), F.col("y").alias("py"), *[rounded(F.col(f"w.{a}"), a) for a in "xyz"])


@query("f17_camera_centre", "SELECT scene_id, view_id, " + ", ".join(r6(f"-(ext[{j}]*ext[4]+ext[{j+4}]*ext[8]+ext[{j+8}]*ext[12])", n) for j, n in ((1, 'x'), (2, 'y'), (3, 'z'))) + " FROM cameras")
def _(t):
    return t.cameras.select("scene_id", "view_id", M.camera_centre(F.col("ext")).alias("c")).select("scene_id", "view_id", *[rounded(F.col(f"c.{a}"), a) for a in "xyz"])


@query("f20_in_frame", f"""WITH {SEEN} SELECT scene_id, vid, view_id, coalesce(cz > 0 AND u >= 2 AND u < 2+w-4-1 AND v >= 3 AND v < 3+h-6-1, false) AS in_photo,
 coalesce(cz > 0 AND u >= 1 AND u < w-2 AND v >= 1 AND v < h-2, false) AS in_texture FROM seen""")
def _(t):
    c = F.col
    return _seen(t).select("scene_id", "vid", "view_id",
                           M.in_frame(c("u"), c("v"), c("z_cam"), F.lit(2), F.lit(3), c("w") - 4, c("h") - 6).alias("in_photo"),
                           M.in_texture_frame(c("u"), c("v"), c("z_cam"), c("w"), c("h")).alias("in_texture"))


@query("j6_nearest_gather", f"""WITH {SEEN}, a AS (SELECT *, least(greatest(round_even(u,0),0),w-1)::BIGINT AS px, least(greatest(round_even(v,0),0),h-1)::BIGINT AS py,
 CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN floor(u+0.5)::BIGINT END AS ox, CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN floor(v+0.5)::BIGINT END AS oy FROM seen)
SELECT a.scene_id, a.vid, a.view_id, coalesce(p.depth, 0) AS clamped, coalesce(q.depth, -1) AS strict FROM a
LEFT JOIN pixels p ON ((a.scene_id*5+a.view_id)*30+py)*40+px = ((p.scene_id*5+p.view_id)*30+p.y)*40+p.x
LEFT JOIN pixels q ON ((a.scene_id*5+a.view_id)*30+oy)*40+ox = ((q.scene_id*5+q.view_id)*30+q.y)*40+q.x""")
def _(t):
    w, h = F.col("w"), F.col("h")
    one = G.sample_nearest_clamped(_seen(t), t.pixels, {"depth": 0.0}, w, h).withColumnRenamed("s_depth", "clamped")
    return G.sample_nearest(one, t.pixels, {"depth": -1.0}, w, h).withColumnRenamed("s_depth", "strict").select("scene_id", "vid", "view_id", "clamped", "strict")


def bilinear_sql(src, cols, x, y, missing=0, table="pixels", w=40, h=30):
    """CTE bodies that bilinearly sample ``cols`` of ``table`` (w x h) for rows of ``src`` (must have scene_id, view_id)."""
    joins, exprs = "", {}
    for i, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
        joins += f" LEFT JOIN {table} n{i} ON ((s.scene_id*5+s.view_id)*{h}+y0+{dy})*{w}+x0+{dx} = ((n{i}.scene_id*5+n{i}.view_id)*{h}+n{i}.y)*{w}+n{i}.x AND x0+{dx} < {w} AND y0+{dy} < {h}"
    for c in cols:
        q = [f"coalesce(n{i}.{c}::DOUBLE, {missing})" for i in range(4)]
        exprs[c] = f"({q[0]}*(1-dx)+{q[1]}*dx)*(1-dy)+({q[2]}*(1-dx)+{q[3]}*dx)*dy AS s_{c}"
    return (f"SELECT s.* EXCLUDE (fx, fy, x0, y0, dx, dy), {', '.join(exprs.values())} FROM (SELECT *, fx-x0 AS dx, fy-y0 AS dy FROM (SELECT *, floor(fx)::BIGINT AS x0, floor(fy)::BIGINT AS y0 FROM "
            f"(SELECT *, {x} AS fx, {y} AS fy FROM {src}))) s{joins}")


CLAMP = ("least(greatest(u,0),w-1.001)", "least(greatest(v,0),h-1.001)")
INSIDE = ("CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN u END", "CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN v END")


@query("j7_bilinear_gather", f"""WITH {SEEN}, a AS ({bilinear_sql('seen', ['r'], *CLAMP)}), b AS ({bilinear_sql('a', ['depth'], *INSIDE)})
SELECT scene_id, vid, view_id, {r6('s_r','clamped')}, {r6('CASE WHEN u BETWEEN 0 AND w-1 AND v BETWEEN 0 AND h-1 THEN s_depth ELSE 1000 END','strict')} FROM b""")
def _(t):
    w, h = F.col("w"), F.col("h")
    photos = G.pictures(t.cameras, [(t.pixels, ["r", "depth"])])
    one = G.sample_bilinear_clamped(_seen(t, photos=photos), t.pixels, ["r"], w, h)
    two = G.sample_bilinear(one, t.pixels, {"depth": 1000.0}, w, h)
    return two.select("scene_id", "vid", "view_id", rounded(F.col("s_r"), "clamped"), rounded(F.col("s_depth"), "strict"))


MASK = "m AS (SELECT scene_id, view_id, x, y FROM pixels WHERE mask)"
BOX = "(SELECT unnest(generate_series(-2, 2)) AS dx) a, (SELECT unnest(generate_series(-2, 2)) AS dy) b"


@query("j14_dilate", f"WITH {MASK} SELECT DISTINCT scene_id, view_id, (x+dx)::INT AS x, (y+dy)::INT AS y FROM m, {BOX} WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29")
def _(t):
    return R.dilate(t.pixels.where("mask"), t.cameras, R.box, 2)


@query("j14_close", f"""WITH {MASK}, d AS (SELECT DISTINCT scene_id, view_id, x+dx AS x, y+dy AS y FROM m, (SELECT unnest(generate_series(-1, 1)) AS dx) a, (SELECT unnest(generate_series(-1, 1)) AS dy) b WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29),
n AS (SELECT scene_id, view_id, x+dx AS x, y+dy AS y, count(*) AS n FROM d, (SELECT unnest(generate_series(-1, 1)) AS dx) a, (SELECT unnest(generate_series(-1, 1)) AS dy) b WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29 GROUP BY 1,2,3,4)
SELECT scene_id, view_id, x::INT AS x, y::INT AS y FROM n WHERE n = (CASE WHEN x IN (0,39) THEN 2 ELSE 3 END) * (CASE WHEN y IN (0,29) THEN 2 ELSE 3 END)""")
def _(t):
    return R.close(t.pixels.where("mask"), t.cameras, R.box, 1)


DISC = "disc AS (SELECT dy, unnest(generate_series(-s, s)) AS dx FROM (SELECT dy, round_even(sqrt({r}*{r}-dy*dy), 0)::INT AS s FROM (SELECT unnest(generate_series(-{r}, {r})) AS dy)))"


@query("j14_disc_dilate", f"WITH {DISC.format(r=6)} SELECT DISTINCT scene_id, view_id, (x+dx)::INT AS x, (y+dy)::INT AS y FROM silhouettes, disc WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29")
def _(t):
    return R.dilate(t.silhouettes, t.cameras, R.ellipse, 6)


@query("j14_disc_erode", f"""WITH {DISC.format(r=2)}, room AS (SELECT x, y, count(*) AS n FROM (SELECT unnest(generate_series(0, 39)) AS x) a, (SELECT unnest(generate_series(0, 29)) AS y) b, disc WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29 GROUP BY 1, 2),
held AS (SELECT *, greatest(r, 51) AS level FROM pixels), seen AS (SELECT scene_id, view_id, x+dx AS x, y+dy AS y, count(*) AS n, min(level) AS level FROM held, disc WHERE x+dx BETWEEN 0 AND 39 AND y+dy BETWEEN 0 AND 29 GROUP BY 1,2,3,4)
SELECT scene_id, view_id, s.x::INT AS x, s.y::INT AS y, level FROM seen s JOIN room ON s.y*40+s.x = room.y*40+room.x WHERE s.n = room.n""")
def _(t):
    return R.morph(t.pixels.withColumn("level", F.greatest("r", F.lit(51))), t.cameras, ("shrink",), R.ellipse, 2)


def signed_sql(mask):
    """CTE ``sd`` (key, inside, x, y, d): exact distance to the nearest pixel of the other kind; ``mask`` is a SELECT of cells."""
    return f"""fr AS (SELECT (scene_id*5+view_id)*1200 AS base, unnest(generate_series(0, 1199)) AS place FROM cameras), mk AS MATERIALIZED (SELECT (scene_id*5+view_id)*1200+y*40+x AS key FROM ({mask})),
kk AS MATERIALIZED (SELECT base + place AS key, (base + place) // 40 AS line, place % 40 AS x, place // 40 AS y, mk.key IS NOT NULL AS inside FROM fr LEFT JOIN mk ON base + place = mk.key),
near AS (SELECT p.key, min((p.x-q.x)*(p.x-q.x)) AS dx FROM kk p JOIN kk q ON p.line*2+p.inside::INT = q.line*2+(NOT q.inside)::INT GROUP BY 1),
side AS MATERIALIZED (SELECT key, NOT inside AS inside, x, y, 0 AS dx FROM kk UNION ALL SELECT kk.key, inside, x, y, dx FROM kk JOIN near ON kk.key = near.key),
nk AS (SELECT p.key, sqrt(min(q.dx + (p.y-q.y)*(p.y-q.y))) AS d FROM kk p JOIN side q ON ((p.key//1200)*40+p.x)*2+p.inside::INT = ((q.key//1200)*40+q.x)*2+q.inside::INT GROUP BY 1),
sd AS MATERIALIZED (SELECT kk.*, coalesce(d, 50) AS d FROM kk LEFT JOIN nk ON kk.key = nk.key)"""


@query("j14_signed_distance", f"""WITH {signed_sql('SELECT * FROM silhouettes')}
SELECT key // 6000 AS scene_id, (key // 1200 % 5)::INT AS view_id, x::INT AS x, y::INT AS y, {r6('CASE WHEN inside THEN -d ELSE d END', 'signed')} FROM sd""")
def _(t):
    return R.signed_distance(t.silhouettes, t.cameras).select("scene_id", "view_id", "x", "y", rounded(F.col("signed"), "signed"))


@query("j14_nearest_cell", f"""WITH f AS (SELECT scene_id, view_id, unnest(generate_series(0, 39)) AS x FROM cameras), e AS MATERIALIZED (SELECT scene_id, view_id, x, unnest(generate_series(0, 29)) AS y FROM f),
row AS MATERIALIZED (SELECT e.scene_id, e.view_id, e.x, e.y, min({{'sq': (s.x-e.x)*(s.x-e.x), 'x': s.x}}) AS b FROM e JOIN silhouettes s ON (e.scene_id*5+e.view_id)*30+e.y = (s.scene_id*5+s.view_id)*30+s.y GROUP BY ALL),
best AS (SELECT e.scene_id, e.view_id, e.x, e.y, min({{'sq': b.sq+(r.y-e.y)*(r.y-e.y), 'y': r.y, 'x': b.x}}) AS m FROM e JOIN row r ON (e.scene_id*5+e.view_id)*40+e.x = (r.scene_id*5+r.view_id)*40+r.x GROUP BY ALL)
SELECT scene_id, view_id, x::INT AS x, y::INT AS y, {r6('sqrt(m.sq)', 'distance')}, m.x::INT AS near_x, m.y::INT AS near_y FROM best""")
def _(t):
    return R.distance_field(t.silhouettes, t.cameras).withColumn("distance", rounded(F.col("distance"), "distance"))


def gaussian_sql(n, axis, sigma=24):
    """Weights of reading position ``q`` for position ``p`` of an axis of ``n`` pixels, mirrored at both ends."""
    r, period = round(4 * sigma), 2 * (n - 1)
    return (f"{axis}k AS MATERIALIZED (SELECT p, least((p+d+{period}*1000) % {period}, {period} - (p+d+{period}*1000) % {period}) AS q, sum(exp(-(d*d)/{2 * sigma * sigma}.0::DOUBLE)/z) AS w FROM (SELECT unnest(generate_series(0, {n - 1})) AS p), "
            f"(SELECT unnest(generate_series(-{r}, {r})) AS d), (SELECT sum(exp(-(d*d)/{2 * sigma * sigma}.0::DOUBLE)) AS z FROM (SELECT unnest(generate_series(-{r}, {r})) AS d)) GROUP BY 1, 2)")


def blur_sql(src, w=40, h=30, sigma=24):
    """CTE ``blurred`` (scene_id, view_id, x, y, blur, weight) of the masked column l of ``src``."""
    return (f"{gaussian_sql(w, 'bx', sigma)}, {gaussian_sql(h, 'by', sigma)}, bl AS MATERIALIZED (SELECT s.scene_id, s.view_id, p AS x, s.y, sum(w*l) AS l, sum(w) AS m FROM {src} s JOIN bxk ON s.x = q WHERE mask GROUP BY 1,2,3,4), "
            f"blurred AS MATERIALIZED (SELECT b.scene_id, b.view_id, b.x, p AS y, sum(w*l)/greatest(sum(w*m), 1e-5) AS blur, sum(w*m) AS weight FROM bl b JOIN byk ON b.y = q GROUP BY 1,2,3,4)")


@query("g26_masked_blur", f"""WITH lum AS (SELECT *, r*0.2126+g*0.7152+b*0.0722 AS l FROM pixels), {blur_sql('lum')}
SELECT scene_id, view_id, x::INT AS x, y::INT AS y, {r6('blur', 'blur')}, {r6('weight', 'weight')} FROM blurred""")
def _(t):
    luma = t.pixels.withColumn("l", F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722)
    return R.masked_gaussian(luma, t.cameras, "l", 24.0).where("weight > 0").select("scene_id", "view_id", "x", "y", rounded(F.col("blur_l"), "blur"), rounded(F.col("weight"), "weight"))


@query("f26_display_transform", f"""WITH s AS (SELECT scene_id, (min(x)+max(x))/2 AS mx, (min(y)+max(y))/2 AS my, (min(z)+max(z))/2 AS mz, 2.0::DOUBLE/greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM vertices GROUP BY 1)
SELECT v.scene_id, vid, {r6('(x-mx)*s','dx')}, {r6('(y-my)*s*-1','dy')}, {r6('(z-mz)*s*-1','dz')} FROM vertices v JOIN s ON v.scene_id = s.scene_id""")
def _(t):
    return H.display_transform(t.vertices).select("scene_id", "vid", *[rounded(F.col(f"d{a}"), f"d{a}") for a in "xyz"])


@query("f26_display_transform_robust", f"""WITH {BACK}, s AS (SELECT scene_id, median(x) AS mx, median(y) AS my, median(z) AS mz, 2.0::DOUBLE/greatest(quantile_cont(x,0.99)-quantile_cont(x,0.01), quantile_cont(y,0.99)-quantile_cont(y,0.01), quantile_cont(z,0.99)-quantile_cont(z,0.01)) AS s FROM back WHERE mask GROUP BY 1)
SELECT v.scene_id, view_id, px, py, {r6('(x-mx)*s','dx')}, {r6('(y-my)*s*-1','dy')}, {r6('(z-mz)*s*-1','dz')} FROM back v JOIN s ON v.scene_id = s.scene_id WHERE mask""")
def _(t):
    pts = _back(t).where("mask").select("scene_id", "view_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("w.x").alias("x"), F.col("w.y").alias("y"), F.col("w.z").alias("z"))
    return H.display_transform(pts, robust=True).select("scene_id", "view_id", "px", "py", *[rounded(F.col(f"d{a}"), f"d{a}") for a in "xyz"])
