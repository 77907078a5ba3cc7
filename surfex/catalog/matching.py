"""Matches, residuals and diverse selection."""

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import matching as A
from ..operators import ranking as K
from ..operators import rules as R
from . import bindings  # noqa: F401
from .geometry import mul_sql, rounded
from .registry import query
from .text import camera, pixel, r6

DIST = "list_distance(a.v::DOUBLE[], b.v::DOUBLE[])"
NEAR = f"""d AS MATERIALIZED (SELECT a.label::BIGINT AS pair_id, a.vec_id AS ia, b.vec_id AS ib, {DIST} AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
fa AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ia ORDER BY d, ib) AS rk, lead(d) OVER (PARTITION BY pair_id, ia ORDER BY d, ib) AS d2 FROM d), fb AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ib ORDER BY d, ia) AS rk, lead(d) OVER (PARTITION BY pair_id, ib ORDER BY d, ia) AS d2 FROM d)"""


def _sides(t):
    v = t.vectors.select(F.col("label").cast("bigint").alias("pair_id"), F.col("vec_id").alias("id"), "v")
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


@query("w11_two_nearest", f"WITH {NEAR} SELECT pair_id, 'a' AS side, ia AS id, ib AS other, rk::INT AS rank, {r6('d','distance')} FROM fa WHERE rk <= 2 UNION ALL SELECT pair_id, 'b', ib, ia, rk::INT, {r6('d','distance')} FROM fb WHERE rk <= 2")
def _(t):
    return A.two_nearest(*_sides(t), 64).select("pair_id", "side", "id", "other", "rank", rounded(F.col("distance"), "distance"))


@query("j12_mutual_ratio_match", f"WITH {NEAR} SELECT fa.pair_id, fa.ia AS id_a, fa.ib AS id_b, {r6('fa.d','distance')} FROM fa JOIN fb ON fa.ia = fb.ia AND fa.ib = fb.ib AND fa.rk = 1 AND fb.rk = 1 WHERE fa.d < 0.98*fa.d2 AND fb.d < 0.98*fb.d2")
def _(t):
    return A.mutual_ratio_match(*_sides(t), 0.98, 64).withColumn("distance", rounded(F.col("distance"), "distance"))


def _t3(m):
    return "[" + ", ".join(f"{m}[{3*j+i+1}]" for i in range(3) for j in range(3)) + "]"


FUND = f"""pp AS (SELECT a.scene_id, a.view_id AS view_a, b.view_id AS view_b, a.ext AS ea, a.k AS ka, b.ext AS eb, b.k AS kb FROM cameras a JOIN cameras b ON a.scene_id*5+(a.view_id+1)%5 = b.scene_id*5+b.view_id),
p1 AS (SELECT *, [ea[1],ea[2],ea[3],ea[5],ea[6],ea[7],ea[9],ea[10],ea[11]] AS ra, [eb[1],eb[2],eb[3],eb[5],eb[6],eb[7],eb[9],eb[10],eb[11]] AS rb,
 [1/ka[1],0,-ka[3]/ka[1],0,1/ka[5],-ka[6]/ka[5],0,0,1] AS ia, [1/kb[1],0,-kb[3]/kb[1],0,1/kb[5],-kb[6]/kb[5],0,0,1] AS ib FROM pp),
p2 AS (SELECT *, {_t3('ra')} AS rat, {_t3('ib')} AS ibt FROM p1), p3 AS (SELECT *, {mul_sql('rb','rat')} AS rr FROM p2),
p4 AS (SELECT *, eb[4]-(rr[1]*ea[4]+rr[2]*ea[8]+rr[3]*ea[12]) AS t0, eb[8]-(rr[4]*ea[4]+rr[5]*ea[8]+rr[6]*ea[12]) AS t1, eb[12]-(rr[7]*ea[4]+rr[8]*ea[8]+rr[9]*ea[12]) AS t2 FROM p3),
p5 AS (SELECT *, [0,-t2,t1,t2,0,-t0,-t1,t0,0] AS sk FROM p4), p6 AS (SELECT *, {mul_sql('ibt','sk')} AS lf, {mul_sql('rr','ia')} AS rg FROM p5), fm AS (SELECT scene_id, view_a, view_b, {mul_sql('lf','rg')} AS f FROM p6)"""


@query("f18_fundamental", f"WITH {FUND} SELECT scene_id, view_a, view_b, {', '.join(r6(f'f[{i+1}]*1000', f'f{i}') for i in range(9))} FROM fm")
def _(t):
    pairs = t.cameras.select("scene_id", F.col("view_id").alias("view_a"), ((F.col("view_id") + 1) % 5).alias("view_b"))
    return A.pair_fundamentals(pairs, t.cameras).select("scene_id", "view_a", "view_b", *[rounded(F.col("f")[i] * 1000, f"f{i}") for i in range(9)])


SAMPSON = f"{FUND}, sm AS (SELECT m.*, f FROM matches m JOIN fm ON m.scene_id*5+m.view_a = fm.scene_id*5+fm.view_a), sl AS (SELECT *, f[1]*xa+f[2]*ya+f[3] AS l0, f[4]*xa+f[5]*ya+f[6] AS l1, f[7]*xa+f[8]*ya+f[9] AS l2, f[1]*xb+f[4]*yb+f[7] AS m0, f[2]*xb+f[5]*yb+f[8] AS m1 FROM sm)"


@query("f19_sampson", f"WITH {SAMPSON} SELECT scene_id, view_a, match_id, {r6('abs(xb*l0+yb*l1+l2)/sqrt(l0*l0+l1*l1+m0*m0+m1*m1+1e-20)','sampson')} FROM sl")
def _(t):
    return A.match_residuals(t.matches, t.cameras).select("scene_id", "view_a", "match_id", rounded(F.col("sampson"), "sampson"))


REPRO = f"""r0 AS (SELECT m.*, p.depth, a.ext, (m.xa-a.k[3])/a.k[1]*p.depth-a.ext[4] AS ax, (m.ya-a.k[6])/a.k[5]*p.depth-a.ext[8] AS ay, p.depth-a.ext[12] AS az FROM matches m JOIN cameras a ON m.scene_id*5+m.view_a = a.scene_id*5+a.view_id
 JOIN pixels p ON ((m.scene_id*5+m.view_a)*30+round_even(ya,0)::BIGINT)*40+round_even(xa,0)::BIGINT = ((p.scene_id*5+p.view_id)*30+p.y)*40+p.x WHERE p.depth > 0),
r1 AS (SELECT r0.* EXCLUDE (ext), ax*ext[1]+ay*ext[5]+az*ext[9] AS x, ax*ext[2]+ay*ext[6]+az*ext[10] AS y, ax*ext[3]+ay*ext[7]+az*ext[11] AS z FROM r0),
r2 AS (SELECT *, {pixel()} FROM (SELECT r1.*, b.ext, b.k, b.w, b.h, {camera('r1.x','r1.y','r1.z')} FROM r1 JOIN cameras b ON r1.scene_id*5+r1.view_b = b.scene_id*5+b.view_id)),
rp AS MATERIALIZED (SELECT scene_id, view_a, view_b, match_id, u, v, w, h, cz, u-xb AS dx, v-yb AS dy, sqrt((u-xb)*(u-xb)+(v-yb)*(v-yb)) AS err FROM r2)"""


@query("j13_reprojection", f"WITH {REPRO} SELECT scene_id, view_a, view_b, match_id, {r6('dx','dx')}, {r6('dy','dy')}, {r6('err','error')} FROM rp")
def _(t):
    return A.reprojection(t.matches, t.pixels, t.cameras).select("scene_id", "view_a", "view_b", "match_id", *[rounded(F.col(c), c) for c in ("dx", "dy", "error")])


@query("j13_visible_reprojection", f"""WITH {REPRO} SELECT rp.scene_id, view_a, match_id, {r6('err','error')} FROM rp JOIN pixels p ON ((rp.scene_id*5+view_b)*30+least(greatest(round_even(v,0),0),h-1)::BIGINT)*40+least(greatest(round_even(u,0),0),w-1)::BIGINT = ((p.scene_id*5+p.view_id)*30+p.y)*40+p.x
 WHERE cz > 0 AND u >= 1 AND u < w-1 AND v >= 1 AND v < h-1 AND p.mask AND abs(p.depth-cz) < 0.02""")
def _(t):
    return A.reprojection(t.matches, t.pixels, t.cameras, 0.02).select("scene_id", "view_a", "match_id", rounded(F.col("error"), "error"))


REPORT = f"{REPRO}, rr AS (SELECT scene_id, view_a, view_b, count(*) AS matches, avg((cz > 0)::INT) AS ahead, median(err) AS median_px, quantile_cont(err, 0.95) AS p95_px, median(dx) AS median_dx, median(dy) AS median_dy, median(err)/max(sqrt(w*w+h*h)) AS diagonal_share FROM rp GROUP BY 1,2,3)"


@query("g27_residual_report", f"WITH {REPORT} SELECT scene_id, view_a, view_b, matches, {', '.join(r6(c, c) for c in ('ahead','median_px','p95_px','median_dx','median_dy','diagonal_share'))} FROM rr")
def _(t):
    rep = A.residual_report(A.reprojection(t.matches, t.pixels, t.cameras))
    return rep.select("scene_id", "view_a", "view_b", "matches", *[rounded(F.col(c), c) for c in ("ahead", "median_px", "p95_px", "median_dx", "median_dy", "diagonal_share")])


@query("f60_match_gate", f"WITH {REPORT} SELECT scene_id, view_a, view_b, median_px <= 2 AND p95_px <= 5 AS gate FROM rr")
def _(t):
    return R.match_gate(A.residual_report(A.reprojection(t.matches, t.pixels, t.cameras))).select("scene_id", "view_a", "view_b", "gate")


@query("w5_holdout_split", "SELECT scene_id, view_a, match_id, (row_number() OVER (PARTITION BY scene_id, view_a ORDER BY yb, xb, match_id) - 1) % 3 = 0 AS holdout FROM matches")
def _(t):
    return K.holdout_split(t.matches, ["yb", "xb", "match_id"], F.floor("yb"), ["scene_id", "view_a"]).select("scene_id", "view_a", "match_id", "holdout")


@query("g22_centroid", f"SELECT (i-1)::INT AS pos, {r6('avg(v[i]::DOUBLE)','mean')} FROM vectors, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i")
def _(t):
    return A.centroid(t.vectors).select("pos", rounded(F.col("mean"), "mean"))


@query("g22_grid_signature", f"SELECT scene_id, view_id, (floor(y*16/30::DOUBLE)*16+floor(x*16/40::DOUBLE))::INT AS cell, {r6('avg(r)/255','r')}, {r6('avg(g)/255','g')}, {r6('avg(b)/255','b')} FROM pixels GROUP BY 1, 2, 3")
def _(t):
    return A.grid_signature(t.pixels, 40, 30).select("scene_id", "view_id", "cell", *[rounded(F.col(c), c) for c in "rgb"])


def _sample_sql(n):
    d = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
    dist = lambda a, b: d.replace("a, b", f"{a}, {b}")
    out = "vv AS MATERIALIZED (SELECT vec_id AS key, sha256(vec_key) AS sha256, v::DOUBLE[] AS v FROM vectors), mean AS MATERIALIZED (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(v[i]) AS m FROM vv, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i))"
    out += f", c0 AS MATERIALIZED (SELECT key, sha256, v, 0 AS rank FROM vv, mean ORDER BY {dist('v', 'c')}, sha256 LIMIT 1), n0 AS MATERIALIZED (SELECT vv.*, {dist('vv.v', 'c0.v')} AS near FROM vv, c0)"
    for i in range(1, n):
        out += f", c{i} AS MATERIALIZED (SELECT key, sha256, v, {i} AS rank FROM n{i-1} WHERE key NOT IN (SELECT key FROM ({' UNION ALL '.join(f'SELECT key FROM c{j}' for j in range(i))})) ORDER BY near DESC, sha256 LIMIT 1), n{i} AS MATERIALIZED (SELECT p.key, p.sha256, p.v, least(p.near, {dist('p.v', f'c{i}.v')}) AS near FROM n{i-1} p, c{i})"
    return out + f", picked AS ({' UNION ALL '.join(f'SELECT key, sha256, rank FROM c{j}' for j in range(n))})"


def _keyed(t):
    return t.vectors.select(F.col("vec_id").alias("key"), F.sha2("vec_key", 256).alias("sha256"), "v")


@query("t1_diverse_sample", f"WITH {_sample_sql(12)} SELECT key, sha256, rank FROM picked")
def _(t):
    return A.diverse_sample(_keyed(t), 12)


@query("u1_use_ledger", f"WITH {_sample_sql(12)} SELECT v.key, CASE WHEN p.key IS NOT NULL THEN 'geometry-and-texture' ELSE 'retained-original' END AS role FROM vv v LEFT JOIN picked p ON v.key = p.key")
def _(t):
    return A.select_and_record(_keyed(t), 12).select("key", "role")


@query("u2_coverage_check", "SELECT count(*) FILTER (vec_id % 7 = 0 AND vec_id % 11 = 0) AS selected_outside, count(*) FILTER (vec_id % 11 = 0) AS ledger_mismatch, count(*) FILTER (vec_id % 11 = 0) = 0 AS valid FROM vectors")
def _(t):
    v = _keyed(t)
    return L.coverage_check(v.where("key % 11 <> 0"), v.where("key % 7 = 0"), v, "key")
