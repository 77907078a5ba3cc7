"""Colour, scores, labels, fill, texels and reports."""

from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import matrices as M
from ..operators import gather as G
from ..operators import mesh as H
from ..operators import raster as Z
from ..operators import texture as X
from . import bindings  # noqa: F401
from .geometry import CLAMP, bilinear_sql, rounded
from .mesh import TRI
from .raster import ATLAS, ATLAS_H, ATLAS_W, CENTRES, SURFACE, VIEW_RASTER, VIEW_TRI, _atlas, _centres, _visible, _zbuffer
from .registry import bind, query
from .text import camera, encode, linear, pixel, r6

CELLS = "scene_id, view_id, x, y"


def _px(t, *cols):
    return t.pixels.select("scene_id", "view_id", "x", "y", *[rounded(c, n) for c, n in cols])


@query("f30_srgb_linear", f"SELECT {CELLS}, {r6(linear('r'),'lin')}, {r6(encode('g/400'),'enc')} FROM pixels")
def _(t):
    return _px(t, (K.srgb_linear(F.col("r")), "lin"), (K.srgb_encode(F.col("g") / 400), "enc"))


@query("f31_luma", f"SELECT {CELLS}, {r6('r/7.13::DOUBLE*0.2126::DOUBLE+g/7.13::DOUBLE*0.7152::DOUBLE+b/7.13::DOUBLE*0.0722::DOUBLE','luma')} FROM pixels")
def _(t):
    return _px(t, (K.luma(F.col("r") / 7.13, F.col("g") / 7.13, F.col("b") / 7.13), "luma"))


def lab_sql(src, out):
    f = lambda v: f"CASE WHEN {v} > 0.008856 THEN pow({v}, 1/3::DOUBLE) ELSE {v}*7.787+16/116::DOUBLE END"
    return f"""{out}_l AS (SELECT *, {linear('r')} AS lr, {linear('g')} AS lg, {linear('b')} AS lb FROM {src}),
{out}_x AS (SELECT *, (lr*0.412453+lg*0.357580+lb*0.180423)/0.950456::DOUBLE AS xx, lr*0.212671+lg*0.715160+lb*0.072169 AS yy, (lr*0.019334+lg*0.119193+lb*0.950227)/1.088754::DOUBLE AS zz FROM {out}_l),
{out} AS (SELECT *, CASE WHEN yy > 0.008856 THEN pow(yy, 1/3::DOUBLE)*116-16 ELSE yy*903.3 END AS ll, 500*({f('xx')}-{f('yy')}) AS la, 200*({f('yy')}-{f('zz')}) AS lb2 FROM {out}_x)"""


@query("f32_delta_e76", f"""WITH src AS (SELECT a.scene_id, a.view_id, a.x, a.y, a.r, a.g, a.b FROM pixels a), {lab_sql('src', 'p')}
SELECT p.scene_id, p.view_id, p.x, p.y, {r6('sqrt((p.ll-q.ll)*(p.ll-q.ll)+(p.la-q.la)*(p.la-q.la)+(p.lb2-q.lb2)*(p.lb2-q.lb2))','delta_e')} FROM p JOIN p q ON ((p.scene_id*5+p.view_id)*30+p.y)*41+p.x+1 = ((q.scene_id*5+q.view_id)*30+q.y)*41+q.x""")
def _(t):
    lab = t.pixels.select("scene_id", "view_id", "x", "y", K.lab(F.col("r"), F.col("g"), F.col("b")).alias("p"))
    right = lab.select("scene_id", "view_id", (F.col("x") - 1).alias("x"), "y", F.col("p").alias("q"))
    return lab.join(right, ["scene_id", "view_id", "x", "y"]).select("scene_id", "view_id", "x", "y", rounded(K.delta_e76(F.col("p"), F.col("q")), "delta_e"))


@query("f33_exposure_quality", f"SELECT {CELLS}, {r6('least(greatest(r/24, 0.35), 1)*least(greatest((255-r)/12, 0.35), 1)','quality')} FROM pixels")
def _(t):
    return _px(t, (K.exposure_quality(F.col("r")), "quality"))


@query("f39_quality_code", "SELECT scene_id, view_id, x, y, CASE WHEN NOT mask THEN 0 WHEN confidence >= 2 AND r/250 >= 0.15 THEN 2 ELSE 1 END AS quality_code FROM pixels")
def _(t):
    return t.pixels.select("scene_id", "view_id", "x", "y", K.quality_code(F.col("mask").cast("int"), F.col("confidence"), F.col("r") / 250).alias("quality_code"))


@query("f40_palette", """WITH c AS (SELECT DISTINCT n_nationkey AS code, 24 AS n FROM nation), h AS (SELECT code, (code-1)/n::DOUBLE AS h FROM c), s AS (SELECT *, floor(h*6) AS i, h*6-floor(h*6) AS f FROM h),
v AS (SELECT code, i, 0.95::DOUBLE AS v, 0.95::DOUBLE*0.25 AS p, 0.95*(1-f*0.75::DOUBLE) AS q, 0.95*(1-(1-f)*0.75::DOUBLE) AS u FROM s), o AS (SELECT code, CASE (i+6)::INT % 6 WHEN 0 THEN [v,u,p] WHEN 1 THEN [q,v,p] WHEN 2 THEN [p,v,u] WHEN 3 THEN [p,q,v] WHEN 4 THEN [u,p,v] ELSE [v,p,q] END AS c FROM v)
SELECT code, CASE WHEN code = 0 THEN 125 ELSE round_even(c[1]*255,0)::INT END AS r, CASE WHEN code = 0 THEN 125 ELSE round_even(c[2]*255,0)::INT END AS g, CASE WHEN code = 0 THEN 125 ELSE round_even(c[3]*255,0)::INT END AS b FROM o""")
def _(t):
    c = K.palette_rgb(F.col("code"), F.lit(24))
    return t.nation.select(F.col("n_nationkey").alias("code")).select("code", *[c[i].alias(n) for i, n in enumerate("rgb")])


@query("f42_class_color", "SELECT scene_id, fid, CASE WHEN completion THEN 197 ELSE 244 END AS r, CASE WHEN completion THEN 88 ELSE 160 END AS g, CASE WHEN completion THEN 235 ELSE 42 END AS b FROM faces")
def _(t):
    c = K.class_color(F.col("completion"))
    return t.faces.select("scene_id", "fid", *[c[i].alias(n) for i, n in enumerate("rgb")])


SCORES = f"""{VIEW_RASTER}, {CENTRES}, o AS (SELECT *, -(ext[1]*ext[4]+ext[5]*ext[8]+ext[9]*ext[12])-x AS dx, -(ext[2]*ext[4]+ext[6]*ext[8]+ext[10]*ext[12])-y AS dy, -(ext[3]*ext[4]+ext[7]*ext[8]+ext[11]*ext[12])-z AS dz FROM vis),
s1 AS (SELECT *, sqrt(dx*dx+dy*dy+dz*dz) AS dl FROM o), s2 AS (SELECT *, greatest((nx*dx+ny*dy+nz*dz)/dl, 0) AS facing FROM s1),
s3 AS (SELECT scene_id, fid, view_id, facing, facing*least(greatest(md/3,0),1)*valid::INT AS angle, (k[1]/dl)*(k[1]/dl)*valid::INT AS density, facing*facing*facing*least(greatest(md/3,0),1)*valid::INT AS geometry_score, md FROM s2),
sc AS (SELECT *, density/greatest(max(density) OVER (PARTITION BY scene_id, fid), 1e-6) AS relative_density FROM s3)"""


def _scores(t):
    centre = M.camera_centre(F.col("ext"))
    seen = _visible(t).select("*", G.once(ox=centre["x"], oy=centre["y"], oz=centre["z"]))
    return X.view_scores(seen, F.col("mask_distance") * 20)


@query("f34_view_scores", f"WITH {SCORES} SELECT scene_id, fid, view_id, {r6('facing','facing')}, {r6('angle','angle')}, {r6('geometry_score','geometry_score')}, {r6('angle*relative_density*least(greatest(md*20/24,0.35),1)*least(greatest((255-md*20)/12,0.35),1)','quality_score')} FROM sc")
def _(t):
    return _scores(t).select("scene_id", "fid", "view_id", *[rounded(F.col(c), c) for c in ("facing", "angle", "geometry_score", "quality_score")])


@query("w6_relative_density", f"WITH {SCORES} SELECT scene_id, fid, view_id, {r6('relative_density','relative_density')} FROM sc")
def _(t):
    return _scores(t).select("scene_id", "fid", "view_id", rounded(F.col("relative_density"), "relative_density"))


BEST = "best AS (SELECT scene_id, fid, view_id, score, score > 1e-6 AS possible FROM face_scores QUALIFY row_number() OVER (PARTITION BY scene_id, fid ORDER BY score DESC, view_id) = 1)"


@query("w3_best_view", f"WITH {BEST} SELECT * FROM best")
def _(t):
    return X.best_view(t.face_scores)


@query("w4_vertex_color_view", """WITH b AS (SELECT *, scene_id*1000+vid AS key FROM vertex_support QUALIFY row_number() OVER (PARTITION BY scene_id, vid ORDER BY score DESC, view_id) = 1)
SELECT v.scene_id, v.vid, coalesce(b.view_id, -1) AS color_view, floor(least(greatest(coalesce(b.r,145),0),255))::INT AS r, floor(least(greatest(coalesce(b.g,120),0),255))::INT AS g, floor(least(greatest(coalesce(b.b,90),0),255))::INT AS b FROM vertices v LEFT JOIN b ON v.scene_id*1000+v.vid = b.key""")
def _(t):
    return X.vertex_color_view(t.vertex_support, t.vertices)


PAIRS = f"""gd AS MATERIALIZED (SELECT scene_id, fid, scene_id*1000+fid AS key, view_id, greatest({linear('r')},1e-5) AS r, greatest({linear('g')},1e-5) AS g, greatest({linear('b')},1e-5) AS b FROM lit_scores WHERE score > 0.15 AND least(r,g,b) > 15),
pr AS (SELECT a.scene_id, a.view_id AS view_i, b.view_id AS view_j, count(*) AS faces, median(ln(b.r/a.r)) AS lr, median(ln(b.g/a.g)) AS lg, median(ln(b.b/a.b)) AS lb FROM gd a JOIN gd b ON a.key = b.key AND a.view_id < b.view_id GROUP BY 1,2,3 HAVING count(*) >= 200)"""


def _pairs(t):
    return X.exposure_pairs(t.lit_scores)


@query("g20_exposure_pairs", f"WITH {PAIRS} SELECT scene_id, view_i, view_j, faces, {r6('lr','log_r')}, {r6('lg','log_g')}, {r6('lb','log_b')} FROM pr")
def _(t):
    return _pairs(t).select("scene_id", "view_i", "view_j", "faces", *[rounded(F.col(f"log_{c}"), f"log_{c}") for c in "rgb"])


GAINS = f"""{PAIRS}, nv AS (SELECT scene_id, view_i AS i, view_j AS j, lr, lg, lb FROM pr), ent AS (SELECT scene_id, i AS r, i AS c, 1.0::DOUBLE AS v FROM nv UNION ALL SELECT scene_id, j, j, 1.0 FROM nv UNION ALL SELECT scene_id, i, j, -1.0 FROM nv UNION ALL SELECT scene_id, j, i, -1.0 FROM nv
 UNION ALL SELECT scene_id, i, 5, lr FROM nv UNION ALL SELECT scene_id, j, 5, -lr FROM nv UNION ALL SELECT scene_id, i, 6, lg FROM nv UNION ALL SELECT scene_id, j, 6, -lg FROM nv UNION ALL SELECT scene_id, i, 7, lb FROM nv UNION ALL SELECT scene_id, j, 7, -lb FROM nv
 UNION ALL SELECT scene_id, n, n, 1e-9 + CASE WHEN n = 0 THEN 100 ELSE 0 END FROM (SELECT DISTINCT scene_id FROM nv), (SELECT unnest(generate_series(0, 4)) AS n)),
sp0 AS (SELECT * FROM (SELECT DISTINCT scene_id FROM nv), (SELECT unnest(generate_series(0, 4)) AS r), (SELECT unnest(generate_series(0, 7)) AS c)), sy AS (SELECT s.scene_id, s.r, s.c, coalesce(sum(v), 0) AS v FROM sp0 s LEFT JOIN ent e ON s.scene_id = e.scene_id AND s.r = e.r AND s.c = e.c GROUP BY 1,2,3),
mx AS (SELECT scene_id, list(row ORDER BY r) AS m FROM (SELECT scene_id, r, list(v ORDER BY c) AS row FROM sy GROUP BY 1, 2) GROUP BY 1),
el AS (SELECT scene_id, 0 AS k, m FROM mx UNION ALL SELECT scene_id, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k+1]) ELSE list_transform(row, lambda v, q: v - row[k+1] * m[k+1][q] / m[k+1][k+1]) END) FROM el WHERE k < 5),
gn AS (SELECT scene_id, unnest(generate_series(0, 4)) AS view_id, m FROM el WHERE k = 5), gains AS (SELECT c.scene_id, c.view_id, {', '.join(f"CASE WHEN u.scene_id IS NULL THEN 1 ELSE least(greatest(exp(g.m[c.view_id+1][{6 + q}]), 0.65), 1.6) END AS gain_{c}" for q, c in enumerate('rgb'))}
 FROM cameras c LEFT JOIN gn g ON c.scene_id = g.scene_id AND c.view_id = g.view_id LEFT JOIN (SELECT scene_id, i AS view_id FROM nv UNION SELECT scene_id, j FROM nv) u ON c.scene_id = u.scene_id AND c.view_id = u.view_id)"""


@query("g21_exposure_gains", f"WITH RECURSIVE {GAINS} SELECT scene_id, view_id, {', '.join(r6(f'gain_{c}', f'gain_{c}') for c in 'rgb')} FROM gains")
def _(t):
    return X.exposure_gains(_pairs(t), t.cameras).select("scene_id", "view_id", *[rounded(F.col(f"gain_{c}"), f"gain_{c}") for c in "rgb"])


def _labels_sql(rounds, scores="face_scores"):
    out = "own AS MATERIALIZED (SELECT scene_id*1000+fid AS key, view_id, score FROM {scores} WHERE score > 1e-6), ways AS MATERIALIZED (SELECT scene_id*1000+fid_a AS p, scene_id*1000+fid_b AS q FROM adjacency UNION ALL SELECT scene_id*1000+fid_b, scene_id*1000+fid_a FROM adjacency), fk AS (SELECT scene_id*1000+fid AS key FROM faces)".replace("{scores}", scores)
    pick = "SELECT f.key, coalesce(b.view_id, 0) AS label FROM fk f LEFT JOIN (SELECT key, view_id FROM {s} QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, view_id) = 1) b ON f.key = b.key"
    out += f", l0 AS MATERIALIZED ({pick.format(s='own')})"
    for i in range(rounds):
        out += f", o{i} AS (SELECT o.key, o.view_id, o.score + coalesce(n, 0)*0.1::DOUBLE AS score FROM own o LEFT JOIN (SELECT w.p*10+l.label AS kv, count(*) AS n FROM ways w JOIN l{i} l ON w.q = l.key GROUP BY 1) v ON o.key*10+o.view_id = v.kv), l{i+1} AS MATERIALIZED ({pick.format(s=f'o{i}')})"
    return out + f", lab AS (SELECT key // 1000 AS scene_id, key % 1000 AS fid, CASE WHEN key IN (SELECT key FROM own) THEN label ELSE -1 END AS label FROM l{rounds})"


def _labels(t, rounds=8):
    return X.smooth_labels(t.face_scores, H.face_adjacency(t.faces), t.faces, rounds)


@query("r2_smooth_labels", f"WITH {_labels_sql(8)} SELECT * FROM lab")
def _(t):
    return _labels(t)


def fill_sql(known, name="filled"):
    """CTE ``filled`` for a table ``known`` (key, r, g, b) of faces that have a photo; needs RECURSIVE, ``ways`` (p, q) and ``fk`` (key).

    A face's step is its least number of edges to a known face; its colour is the mean over the neighbours one step nearer.
    """
    return f"""reach AS (SELECT key, 0 AS step FROM {known} UNION SELECT w.p, step + 1 FROM reach JOIN ways w ON w.q = reach.key WHERE step < 64), far AS MATERIALIZED (SELECT key, min(step) AS step FROM reach GROUP BY 1),
tint AS (SELECT key, 0 AS step, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM {known} UNION ALL SELECT f.key, f.step, avg(c.r), avg(c.g), avg(c.b) FROM tint c JOIN ways w ON w.q = c.key JOIN far f ON f.key = w.p AND f.step = c.step + 1 GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT f.key // 1000 AS scene_id, f.key % 1000 AS fid, coalesce(step, -1) AS step, floor(least(greatest(coalesce(r,145),0),255))::INT AS r, floor(least(greatest(coalesce(g,120),0),255))::INT AS g, floor(least(greatest(coalesce(b,90),0),255))::INT AS b FROM fk f LEFT JOIN tint t ON f.key = t.key)"""


FILL = f"""{BEST.replace('face_scores', 'holed_scores')}, ways AS MATERIALIZED (SELECT scene_id*1000+fid_a AS p, scene_id*1000+fid_b AS q FROM adjacency UNION ALL SELECT scene_id*1000+fid_b, scene_id*1000+fid_a FROM adjacency),
fk AS (SELECT scene_id*1000+fid AS key FROM faces), kn AS MATERIALIZED (SELECT b.scene_id*1000+b.fid AS key, s.r, s.g, s.b FROM best b JOIN holed_scores s ON (b.scene_id*1000+b.fid)*5+b.view_id = (s.scene_id*1000+s.fid)*5+s.view_id WHERE possible), {fill_sql('kn')}"""


def _face_colors(t):
    best = X.best_view(t.holed_scores, carry=("r", "g", "b"))
    return t.faces.select("scene_id", "fid").join(best, ["scene_id", "fid"], "left").select("scene_id", "fid", F.coalesce("possible", F.lit(False)).alias("known"), "r", "g", "b")


@query("r3_diffuse_fill", f"WITH RECURSIVE {FILL} SELECT scene_id, fid, step FROM filled")
def _(t):
    return X.diffuse_fill(_face_colors(t), H.face_adjacency(t.faces)).select("scene_id", "fid", "step")


@query("r3_fill_colors", f"WITH RECURSIVE {FILL} SELECT scene_id, count(*) FILTER (step > 0) AS filled, max(step) AS deepest, count(*) FILTER (step < 0) AS unreached, round(avg(r), 0)::INT AS r FROM filled GROUP BY 1")
def _(t):
    out = X.diffuse_fill(_face_colors(t), H.face_adjacency(t.faces))
    return out.groupBy("scene_id").agg(F.count_if(F.col("step") > 0).alias("filled"), F.max("step").alias("deepest"), F.count_if(F.col("step") < 0).alias("unreached"), F.round(F.avg("r"), 0).cast("int").alias("r"))


@query("j18_apply_preferences", f"""WITH {BEST}, pk AS (SELECT s.scene_id*1000+s.fid AS key, arg_max(s.view_id, r.region_id) AS o FROM face_scores s JOIN regions r ON s.scene_id*5+s.view_id = r.scene_id*5+r.view_id WHERE s.score > 1e-6 AND s.fid % 40 >= x0 AND s.fid % 40 < x1 AND s.fid // 40 >= y0 AND s.fid // 40 < y1 GROUP BY 1)
SELECT b.scene_id, b.fid, coalesce(o, CASE WHEN possible THEN view_id ELSE -1 END) AS label FROM best b LEFT JOIN pk ON b.scene_id*1000+b.fid = pk.key""")
def _(t):
    labels = X.best_view(t.face_scores).select("scene_id", "fid", F.when(F.col("possible"), F.col("view_id")).otherwise(-1).alias("label"))
    poly = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1")))])
    regions = t.regions.select("scene_id", "view_id", F.col("region_id").alias("region_order"), poly.alias("poly"))
    picks = X.region_picks(t.face_scores, regions, F.col("fid") % 40, F.floor(F.col("fid") / 40))
    return X.apply_preferences(labels, picks)


TEXELS = f"""{VIEW_RASTER}, {ATLAS}, {SURFACE}, {BEST}, tl AS (SELECT sp.*, b.view_id, b.score, m.ext, m.k, m.w, m.h FROM sp JOIN best b ON sp.scene_id*1000+sp.fid = b.scene_id*1000+b.fid JOIN cameras m ON b.scene_id*5+b.view_id = m.scene_id*5+m.view_id WHERE b.possible),
tc AS (SELECT *, {pixel()} FROM (SELECT *, {camera()} FROM tl)), tq AS (SELECT *, least(greatest(round_even(u,0),0),w-1)::BIGINT AS qx, least(greatest(round_even(v,0),0),h-1)::BIGINT AS qy FROM tc),
tv AS MATERIALIZED (SELECT q.scene_id, q.tx, q.ty, q.view_id, q.u, q.v, q.w, q.h, q.score, d.distance AS md FROM tq q JOIN zb ON ((q.scene_id*5+q.view_id)*30+qy)*40+qx = ((zb.scene_id*5+zb.view_id)*30+zb.y)*40+zb.x JOIN mask_distances d ON ((q.scene_id*5+q.view_id)*30+qy)*40+qx = ((d.scene_id*5+d.view_id)*30+d.y)*40+d.x
 WHERE cz > 0 AND u >= 1 AND u < w-2 AND v >= 1 AND v < h-2 AND d.distance > 0 AND abs(cz-zb.z) < 0.0025+cz/k[1]*1.5),
ts AS ({bilinear_sql('tv', ['r', 'g', 'b'], *CLAMP)}),
texels AS MATERIALIZED (SELECT t.scene_id, t.x AS tx, t.y AS ty, t.fid, coalesce(s.view_id+1, 0) AS source_code, CASE WHEN s.view_id IS NULL THEN 0 WHEN md >= 2 AND score >= 0.15 THEN 2 ELSE 1 END AS quality_code,
 CASE WHEN s.view_id IS NULL THEN 145 ELSE round_even(least(greatest(s_r,0),255),0)::INT END AS r, CASE WHEN s.view_id IS NULL THEN 120 ELSE round_even(least(greatest(s_g,0),255),0)::INT END AS g, CASE WHEN s.view_id IS NULL THEN 90 ELSE round_even(least(greatest(s_b,0),255),0)::INT END AS b
 FROM tx t LEFT JOIN ts s ON (t.scene_id*1000+t.x)*1000+t.y = (s.scene_id*1000+s.tx)*1000+s.ty)"""


def _texels(t):
    # Labels, corners and fill join the faces; a texel carries them and is shuffled once, to the photo of its view.
    best = X.best_view(t.face_scores)
    label = best.select("scene_id", "fid", F.when(F.col("possible"), F.col("view_id")).otherwise(-1).alias("label"), "score")
    fill = t.faces.select("scene_id", "fid", *[F.lit(v).alias(c) for c, v in zip("rgb", K.FALLBACK_RGB)])
    points = Z.surface_points(_atlas(t, X.faces_to_bake(t.uv_corners, t.corners, label, fill), X.BAKED))
    zbuffer = _zbuffer(t)
    photos = Z.visibility_pictures(t.cameras, zbuffer, t.mask_distances, pixels=t.pixels)
    seen = G.in_views(points, t.cameras, ("k", "w", "h"), "want", photos, how="left").withColumn("fx", F.col("k")[0])
    return X.bake_texels(Z.visible(seen, zbuffer, t.mask_distances), None, None, None, t.pixels)


@query("j11_bake_texels", f"WITH {TEXELS} SELECT scene_id, tx, ty, fid, source_code, quality_code, r, g, b FROM texels")
def _(t):
    return _texels(t)


@query("g16_coverage_report", f"WITH {TEXELS} SELECT scene_id, count(*) AS active, count(*) FILTER (source_code > 0) AS supported, count(*) FILTER (source_code = 0) AS fallback, {r6('count(*) FILTER (source_code > 0)/count(*)::DOUBLE','fraction')} FROM texels GROUP BY 1")
def _(t):
    return X.coverage_report(_texels(t)).withColumn("fraction", rounded(F.col("fraction"), "fraction"))


@query("g16_source_counts", f"WITH {TEXELS} SELECT scene_id, source_code, count(*) AS texels FROM texels GROUP BY 1, 2")
def _(t):
    return X.source_counts(_texels(t))


@query("g16_face_area_coverage", f"WITH {TRI}, {BEST} SELECT t.scene_id, {r6('sum(CASE WHEN possible THEN len/2 ELSE 0 END)/sum(len/2)','area_fraction')} FROM tri t LEFT JOIN best b ON t.scene_id*1000+t.fid = b.scene_id*1000+b.fid GROUP BY 1")
def _(t):
    return X.face_area_coverage(X.best_view(t.face_scores), H.face_metrics(t.corners)).withColumn("area_fraction", rounded(F.col("area_fraction"), "area_fraction"))


@query("g17_coverage_bounds", f"""WITH {TEXELS}, {TRI}, pf AS (SELECT scene_id*1000+fid AS key, count(*) AS n, count(*) FILTER (source_code > 0) AS p FROM texels GROUP BY 1)
SELECT scene_id, {r6('sum(len*coalesce(p/n::DOUBLE,0))/sum(len)','lower')}, {r6('sum(CASE WHEN n IS NULL THEN len ELSE 0 END)/sum(len)','unresolved_fraction')}, count(*) FILTER (n IS NULL) AS unresolved_faces, {r6('sum(len*coalesce(p/n::DOUBLE,0))/sum(len)+sum(CASE WHEN n IS NULL THEN len ELSE 0 END)/sum(len)','upper')} FROM tri LEFT JOIN pf ON scene_id*1000+fid = key GROUP BY 1""")
def _(t):
    out = X.coverage_bounds(_texels(t), H.face_metrics(t.corners))
    return out.withColumns({c: rounded(F.col(c), c) for c in ("lower", "upper", "unresolved_fraction")})


@query("r6_pad_texels", f"""WITH {ATLAS}, {BEST}, a AS MATERIALIZED (SELECT t.scene_id, t.x AS tx, t.y AS ty, (t.scene_id*64+t.y)*256+t.x AS key, floor(coalesce(s.r, 145))::INT AS r, floor(coalesce(s.g, 120))::INT AS g, floor(coalesce(s.b, 90))::INT AS b
  FROM tx t LEFT JOIN best p ON t.scene_id*1000+t.fid = p.scene_id*1000+p.fid LEFT JOIN face_scores s ON (p.scene_id*1000+p.fid)*5+p.view_id = (s.scene_id*1000+s.fid)*5+s.view_id), o AS (SELECT unnest(generate_series(-4, 4)) AS d),
e AS (SELECT a.scene_id, tx+p.d AS tx, ty+q.d AS ty, min({{'sq': p.d*p.d+q.d*q.d, 'y': ty, 'x': tx, 'r': r, 'g': g, 'b': b}}) AS m FROM a, o p, o q WHERE p.d*p.d+q.d*q.d <= 16 GROUP BY 1,2,3)
SELECT scene_id, tx::INT AS tx, ty::INT AS ty, m.r AS r, m.g AS g, m.b AS b, m.sq > 0 AS padding FROM e WHERE tx BETWEEN 0 AND 255 AND ty BETWEEN 0 AND 63""")
def _(t):
    best = X.best_view(t.face_scores, carry=("r", "g", "b"))
    faces = t.uv_corners.join(best.select("scene_id", "fid", "r", "g", "b").hint("merge"), ["scene_id", "fid"], "left")
    active = _atlas(t, faces, ("r", "g", "b")).select("scene_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "r", "g", "b")
    return X.pad_texels(active.select("scene_id", "tx", "ty", *[F.floor(F.coalesce(F.col(c), F.lit(float(v)))).cast("int").alias(c) for c, v in zip("rgb", K.FALLBACK_RGB)]), ATLAS_W, ATLAS_H, 4, single=True)


STRETCH = """st0 AS (SELECT u.scene_id, u.fid, (ub-ua)*256 AS a1, (vb-va)*64 AS a2, (uc-ua)*256 AS c1, (vc-va)*64 AS c2, x1-x0 AS ex, y1-y0 AS ey, z1-z0 AS ez, x2-x0 AS fx, y2-y0 AS fy, z2-z0 AS fz FROM uv_corners u JOIN corners c ON u.scene_id*1000+u.fid = c.scene_id*1000+c.fid),
st1 AS (SELECT *, sqrt(ex*ex+ey*ey+ez*ez) AS l, ex*fx+ey*fy+ez*fz AS d, fx*fx+fy*fy+fz*fz AS ee FROM st0), st2 AS (SELECT *, d/l AS xx, sqrt(greatest(ee-(d/l)*(d/l),0)) AS yy FROM st1 WHERE l > 0),
st3 AS (SELECT *, a1/l AS j11, a2/l AS j21, (c1-a1/l*xx)/yy AS j12, (c2-a2/l*xx)/yy AS j22 FROM st2 WHERE yy > 0), st4 AS (SELECT *, j11*j11+j12*j12+j21*j21+j22*j22 AS s, abs(j11*j22-j12*j21) AS det FROM st3),
st AS (SELECT scene_id, fid, sqrt((s+sqrt(greatest(s*s-4*det*det,0)))/2)/greatest(sqrt(greatest((s-sqrt(greatest(s*s-4*det*det,0)))/2,0)),1e-12) AS stretch, abs(a1*c2-a2*c1)/2 AS texel_area FROM st4)"""


def _stretch(t):
    return X.uv_stretch(t.uv_corners, t.corners.drop("completion", "v0", "v1", "v2"), ATLAS_W, ATLAS_H)


@query("f24_uv_stretch", f"WITH {STRETCH} SELECT scene_id, fid, {r6('stretch','stretch')}, {r6('texel_area','texel_area')} FROM st")
def _(t):
    return _stretch(t).select("scene_id", "fid", rounded(F.col("stretch"), "stretch"), rounded(F.col("texel_area"), "texel_area"))


@query("f25_sampling_density", f"WITH {VIEW_TRI}, {STRETCH}, {BEST} SELECT v.scene_id, v.fid, v.view_id, {r6('abs((px1-px0)*(py2-py0)-(py1-py0)*(px2-px0))/2/nullif(texel_area,0)','density')} FROM vt v JOIN best b ON (v.scene_id*1000+v.fid)*5+v.view_id = (b.scene_id*1000+b.fid)*5+b.view_id JOIN st ON v.scene_id*1000+v.fid = st.scene_id*1000+st.fid WHERE possible")
def _(t):
    labels = X.best_view(t.face_scores).select("scene_id", "fid", F.when(F.col("possible"), F.col("view_id")).otherwise(-1).alias("label"))
    # A face is projected in its chosen view only, and joins its label and its texel area by face, before it is shuffled to its camera.
    wanted = t.corners.select("scene_id", "fid", *[f"{a}{i}" for i in range(3) for a in "xyz"]).join(labels.where("label >= 0"), ["scene_id", "fid"])
    return X.sampling_density(Z.project_corners(wanted, t.cameras, "label"), labels, _stretch(t)).withColumn("density", rounded(F.col("density"), "density"))


@query("g18_dist_stats", f"WITH {STRETCH} SELECT scene_id, {r6('quantile_cont(stretch,0.05)','p05')}, {r6('median(stretch)','median')}, {r6('quantile_cont(stretch,0.95)','p95')}, {r6('max(stretch)','maximum')} FROM st GROUP BY 1")
def _(t):
    return X.dist_stats(_stretch(t), ["scene_id"], "stretch").select("scene_id", *[rounded(F.col(c), c) for c in ("p05", "median", "p95", "maximum")])


LABELLED = f"{BEST}, lb AS (SELECT f.scene_id, f.fid, f.scene_id*1000+f.fid AS key, CASE WHEN possible THEN view_id ELSE -1 END AS label FROM faces f LEFT JOIN best b ON f.scene_id*1000+f.fid = b.scene_id*1000+b.fid)"
SEAMS = f"{LABELLED}, se AS (SELECT a.*, p.label AS label_a, q.label AS label_b, p.label >= 0 AND q.label >= 0 AND p.label <> q.label AS boundary FROM adjacency a JOIN lb p ON a.scene_id*1000+a.fid_a = p.key JOIN lb q ON a.scene_id*1000+a.fid_b = q.key)"


def _best_labels(t):
    best = X.best_view(t.face_scores)
    return t.faces.select("scene_id", "fid").join(best.hint("merge"), ["scene_id", "fid"], "left").select("scene_id", "fid", F.when(F.col("possible"), F.col("view_id")).otherwise(-1).alias("label"))


def _seams(t):
    return X.seam_edges(H.face_adjacency(t.faces), _best_labels(t))


@query("j10_seam_edges", f"WITH {SEAMS} SELECT scene_id, fid_a, fid_b, label_a, label_b, boundary FROM se")
def _(t):
    return _seams(t).select("scene_id", "fid_a", "fid_b", "label_a", "label_b", "boundary")


@query("g19_seam_report", f"""WITH {SEAMS}, de AS (SELECT scene_id, boundary, (fid_a*7+fid_b) % 50 + 0.25::DOUBLE AS d, fid_a % 4 = 0 AS ref FROM se), sc AS (SELECT scene_id, d, 'all' AS scope FROM de UNION ALL SELECT scene_id, d, 'photo-boundary' FROM de WHERE boundary UNION ALL SELECT scene_id, d, 'reference-boundary' FROM de WHERE ref)
SELECT scene_id, scope, count(*) AS edges, {r6('avg(d)','mean')}, {r6('count(*) FILTER (d > 20)/count(*)::DOUBLE','above_20')}, {r6('quantile_cont(d,0.95)','p95')} FROM sc GROUP BY 1, 2""")
def _(t):
    e = _seams(t).withColumn("delta_e", (F.col("fid_a") * 7 + F.col("fid_b")) % 50 + 0.25).withColumn("reference", F.col("fid_a") % 4 == 0)
    return X.seam_report(e.withColumn("delta_e", F.col("delta_e").cast("double"))).select("scene_id", "scope", "edges", *[rounded(F.col(c), c) for c in ("mean", "above_20", "p95")])


SSIM_CHANNEL = "((2*ma{c}*mb{c}+6.5025)*(2*(ab{c}-ma{c}*mb{c})*49/48::DOUBLE+58.5225))/((ma{c}*ma{c}+mb{c}*mb{c}+6.5025)*((aa{c}-ma{c}*ma{c}+bb{c}-mb{c}*mb{c})*49/48::DOUBLE+58.5225))"


@query("g29_region_ssim", f"""WITH bx AS (SELECT scene_id, region_id, view_id, unnest(generate_series(x0, x1-1)) AS x, y0, y1 FROM regions), cell AS (SELECT scene_id, region_id, view_id, x, unnest(generate_series(y0, y1-1)) AS y FROM bx),
f AS MATERIALIZED (SELECT c.scene_id*25+c.region_id AS region, c.x, c.y, {', '.join(f'coalesce({t}.{c}, 0) AS {t}{c}' for t in 'ab' for c in 'rgb')} FROM cell c LEFT JOIN pixels a ON ((c.scene_id*5+c.view_id)*30+c.y)*40+c.x = ((a.scene_id*5+a.view_id)*30+a.y)*40+a.x LEFT JOIN pixels_b b ON ((c.scene_id*5+c.view_id)*30+c.y)*40+c.x = ((b.scene_id*5+b.view_id)*30+b.y)*40+b.x),
o AS (SELECT unnest(generate_series(-3, 3)) AS d), w AS (SELECT region, x+p.d AS x, y+q.d AS y, {', '.join(f'sum(a{c})/49 AS ma{c}, sum(b{c})/49 AS mb{c}, sum(a{c}*a{c})/49 AS aa{c}, sum(b{c}*b{c})/49 AS bb{c}, sum(a{c}*b{c})/49 AS ab{c}' for c in 'rgb')} FROM f, o p, o q GROUP BY 1,2,3 HAVING count(*) = 49)
SELECT region // 25 AS scene_id, (region % 25)::INT AS region_id, {r6('avg((' + '+'.join(SSIM_CHANNEL.format(c=c) for c in 'rgb') + ')/3)','ssim')}, count(*) AS windows FROM w GROUP BY 1, 2""")
def _(t):
    return X.region_ssim(t.pixels, t.pixels_b, t.regions).withColumn("ssim", rounded(F.col("ssim"), "ssim"))
