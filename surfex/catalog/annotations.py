"""Annotated mask revision over the test tables."""

import uuid

from pyspark.sql import functions as F

from ..operators import masks as S
from ..session import checkpoint_folder
from ..sources import readers, sinks
from . import bindings  # noqa: F401
from .registry import bind, query

# Background quadrilaterals in working pixels (photos of 1200 x 1600), a few per view.
bind("quads", """
SELECT scene_id, view_id, region_id, x0 * 30e0 + 7 AS xa, y0 * 53e0 + 90 AS ya, x0 * 30e0 + 160 AS xb, y0 * 53e0 + 11 AS yb,
  x0 * 30e0 + 190 AS xc, y0 * 53e0 + 230 AS yc, x0 * 30e0 + 41 AS xd, y0 * 53e0 + 250 AS yd FROM regions WHERE region_id % 3 <> 1""")

DEFAULT_MARGIN, MARGIN_1, GAP, START, BOX, BLUE_RED, BLUE_GREEN, BLUE_LEAST, SKY_MARGIN = 60, 53, 100, 1000, (100, 50, 900, 800), 0.9, 0.8, 8, 1


def _notes(t):
    """Written as one document per scene and read back."""
    path = f"{checkpoint_folder(t.spark)}/storage/{uuid.uuid4().hex}"
    name = F.concat(F.lit("p"), F.col("view_id").cast("string"))
    quad = F.array(*[F.array(f"x{c}", f"y{c}") for c in "abcd"])
    photos = t.quads.groupBy("scene_id", name.alias("name")).agg(F.sort_array(F.collect_list(quad)).alias("quads"))
    notes = photos.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "quads"))).alias("backgroundPolygons"))
    sky = F.struct(F.create_map(*[x for v in (0, 2) for x in (F.lit(f"p{v}"), F.array(*[F.lit(float(b)) for b in BOX]))]).alias("boxes"), F.lit(BLUE_RED).alias("blueRedRatio"),
                   F.lit(BLUE_GREEN).alias("blueGreenRatio"), F.lit(float(BLUE_LEAST)).alias("minimumBlueMinusRed"), F.lit(SKY_MARGIN).alias("fullPixelMargin"))
    notes = notes.withColumns({"lowerBoundaryMarginWorkingPixels": DEFAULT_MARGIN + F.col("scene_id") % 3 * 50.0, "perPhotoLowerBoundaryMarginWorkingPixels": F.create_map(F.lit("p1"), F.lit(float(MARGIN_1))),
                               "lowerBoundaryMarginStartsAtWorkingY": F.lit(float(START)), "manualExclusionMarginWorkingPixels": F.lit(float(GAP)), "instrumentSkyExclusion": sky})
    sinks.write_annotations(notes, path)
    return readers.read_annotations(t.spark, path, t.cameras.select("scene_id", "view_id", name.alias("name")))


@query("s11_annotations", f"""WITH n AS (SELECT scene_id, view_id, count(*) AS polygons, min(xa) AS left_x FROM quads GROUP BY 1, 2), noted AS (SELECT DISTINCT scene_id FROM quads)
SELECT c.scene_id, c.view_id, coalesce(polygons, 0) AS polygons, coalesce(left_x, -1) + 0.0::DOUBLE AS left_x, CASE WHEN c.view_id = 1 THEN {MARGIN_1} ELSE {DEFAULT_MARGIN} + c.scene_id % 3 * 50 END + 0.0::DOUBLE AS boundary_margin, c.view_id IN (0, 2) AS has_sky
FROM cameras c JOIN noted s ON c.scene_id = s.scene_id LEFT JOIN n ON c.scene_id*5+c.view_id = n.scene_id*5+n.view_id""")
def _(t):
    first = F.coalesce(F.array_min(F.transform("polygons", lambda p: p[0]["x"])), F.lit(-1.0))
    return _notes(t).select("scene_id", "view_id", F.size("polygons").cast("long").alias("polygons"), first.alias("left_x"), "boundary_margin", F.col("sky_box").isNotNull().alias("has_sky"))


REVISED = f"""views AS (SELECT scene_id, view_id, (scene_id*5+view_id)*1200 AS base, round_even(CASE WHEN view_id = 1 THEN {MARGIN_1} ELSE {DEFAULT_MARGIN} + scene_id % 3 * 50 END * (h/1600::DOUBLE), 0)::INT AS inset FROM cameras),
dense AS MATERIALIZED (SELECT v.scene_id, v.view_id, v.inset, v.base, base + place AS key, place % 40 AS x, place // 40 AS y, CASE WHEN p.x IS NULL OR mask THEN 255 ELSE floor(p.r)::INT END AS level, p.r, p.g, p.b
 FROM (SELECT *, unnest(generate_series(0, 1199)) AS place FROM views) v LEFT JOIN pixels p ON v.base + place = (p.scene_id*5+p.view_id)*1200+p.y*40+p.x),
edge AS (SELECT (scene_id*5+view_id)*30 AS line, region_id, unnest([{', '.join(f"{{'ex': x{a}, 'ey': y{a}, 'fx': x{b}, 'fy': y{b}}}" for a, b in ('ab', 'bc', 'cd', 'da'))}], recursive := true) FROM quads),
scaled AS (SELECT line, region_id, {', '.join(f"({c}+0.5)*({n}/{w}::DOUBLE)-0.5 AS {c}" for c, n, w in (('ex', 40, 1200), ('ey', 30, 1600), ('fx', 40, 1200), ('fy', 30, 1600)))} FROM edge),
hit AS (SELECT key FROM dense d JOIN scaled s ON d.base//40 = s.line AND (ey > y) <> (fy > y) AND x < ex + (fx-ex)*(y-ey)/(fy-ey) GROUP BY key, region_id HAVING count(*) % 2 = 1),
disc AS MATERIALIZED (SELECT r, dy, unnest(generate_series(-s, s)) AS dx FROM (SELECT r, dy, round_even(sqrt(r*r-dy*dy), 0)::INT AS s FROM (SELECT r, unnest(generate_series(-r, r)) AS dy FROM (SELECT unnest(generate_series(0, 5)) AS r)))),
gone AS (SELECT DISTINCT (key//1200)*1200 + (key % 1200//40+dy)*40 + key % 40 + dx AS key FROM hit JOIN disc ON r = round_even({GAP}*(30/1600::DOUBLE), 0) WHERE key % 40 + dx BETWEEN 0 AND 39 AND key % 1200//40+dy BETWEEN 0 AND 29),
l1 AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN g.key IS NULL THEN level ELSE 0 END AS level), level AS before FROM dense d LEFT JOIN gone g ON d.key = g.key),
inner_ AS (SELECT a.key, min(b.level) AS level FROM l1 a JOIN disc ON disc.r = a.inset JOIN l1 b ON a.key + dy*40 + dx = b.key WHERE a.x + dx BETWEEN 0 AND 39 AND a.y + dy BETWEEN 0 AND 29 GROUP BY 1),
l2 AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN y >= round_even({START}*(30/1600::DOUBLE), 0) THEN i.level ELSE a.level END AS level), view_id IN (0, 2) AND {' AND '.join(f"{v} {op} round_even(({b}+0.5)*(30/1600::DOUBLE)-0.5, 0)" for v, op, b in zip('xyxy', ('>=', '>=', '<', '<'), BOX))} AS boxed FROM l1 a JOIN inner_ i ON a.key = i.key),
blue AS (SELECT DISTINCT base + (y+p.d)*40 + x+q.d AS key FROM l2, (SELECT unnest([-1, 0, 1]) AS d) p, (SELECT unnest([-1, 0, 1]) AS d) q WHERE boxed AND b > {BLUE_RED}*r AND b > {BLUE_GREEN}*g AND b-r > {BLUE_LEAST} AND x+q.d BETWEEN 0 AND 39 AND y+p.d BETWEEN 0 AND 29),
final AS (SELECT l.*, boxed AND s.key IS NOT NULL AS blue, CASE WHEN boxed AND s.key IS NOT NULL THEN 0 ELSE level END AS after FROM l2 l LEFT JOIN blue s ON l.key = s.key)"""


def _revised(t):
    places = t.cameras.select("scene_id", "view_id", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("place"), "w").select(
        "scene_id", "view_id", (F.col("place") % F.col("w")).alias("x"), F.floor(F.col("place") / F.col("w")).cast("int").alias("y"))
    levels = places.join(t.pixels, ["scene_id", "view_id", "x", "y"], "left").select(
        "scene_id", "view_id", "x", "y", F.when(F.col("mask").isNull() | F.col("mask"), 255).otherwise(F.floor("r").cast("int")).alias("level"))
    return S.revise_masks(levels, t.pixels, t.cameras, _notes(t))


@query("u5_revise_masks", f"WITH {REVISED} SELECT scene_id, view_id, x::INT AS x, y::INT AS y, after::INT AS level FROM final WHERE after > 0 AND scene_id IN (SELECT scene_id FROM quads)")
def _(t):
    return _revised(t)["levels"]


@query("g24_annotated_revision", f"""WITH {REVISED}, n AS (SELECT scene_id*5+view_id AS key, count(*) AS polygons FROM quads GROUP BY 1)
SELECT scene_id, view_id, count(*) FILTER (before >= 254) AS before, count(*) FILTER (after >= 254) AS after, count(*) FILTER (before >= 254 AND after < 254) AS removed, count(*) FILTER (blue AND level >= 254) AS sky_removed, any_value(coalesce(polygons, 0)) AS polygons
FROM final LEFT JOIN n ON scene_id*5+view_id = n.key WHERE scene_id IN (SELECT scene_id FROM quads) GROUP BY 1, 2""")
def _(t):
    return _revised(t)["report"]
