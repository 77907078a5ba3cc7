"""View scores, exposure, labels, fill, texels and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as K
from ..functions import matrices as M
from ..session import cut_lineage
from . import grids as R
from . import raster as Z
from .gather import sample_bilinear_clamped
from .mesh import both_ways
from .ranking import exact_quantiles

FACE = ["scene_id", "fid"]
#: What a face's texels carry to be baked where they are.
BAKED = (*Z.SIDES, "want", "score", "fill_r", "fill_g", "fill_b")


def view_scores(centres: DataFrame, luminance: Column | None = None) -> DataFrame:
    """Facing, angle, density, geometry score and quality score of every face in every view.

    Needs nx..nz, x..z, the camera position ox..oz, fx, mask_distance and valid. The relative density divides by the
    face's best view; a face has as many rows as its scene has views, and one ``part`` where the points were dealt by face.
    """
    c = F.col
    d = [c(f"o{a}") - c(a) for a in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    facing = F.greatest((c("nx") * d[0] + c("ny") * d[1] + c("nz") * d[2]) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    on = c("valid").cast("double")
    edge = K.clip(c("mask_distance") / 3.0, 0.0, 1.0)
    out = centres.withColumns({"facing": facing, "_len": length}).withColumns({
        "angle": c("facing") * edge * on, "density": (c("fx") / c("_len")) * (c("fx") / c("_len")) * on,
        "geometry_score": c("facing") * c("facing") * c("facing") * edge * on})
    face = Window.partitionBy(*[c for c in ("part",) if c in out.columns], *FACE)
    out = out.withColumn("_best", F.max("density").over(face)).where("scene_id IS NOT NULL AND fid IS NOT NULL") \
        .withColumn("relative_density", c("density") / F.greatest("_best", F.lit(1e-6)))
    light = F.lit(1.0) if luminance is None else K.exposure_quality(luminance)
    return out.withColumn("quality_score", c("angle") * c("relative_density") * light).drop("_len", "_best", "part")


def best_view(scores: DataFrame, keys: list[str] = FACE, score: str = "score", carry: tuple[str, ...] = ()) -> DataFrame:
    """Highest score, lowest view on ties; possible = the score exceeds 1e-6. One pre-aggregated maximum per key."""
    top = scores.groupBy(*keys).agg(F.max(F.struct(score, (-F.col("view_id")).alias("_n"), *carry)).alias("_m"))
    return top.select(*keys, (-F.col("_m._n")).alias("view_id"), F.col(f"_m.{score}").alias(score),
                      *[F.col(f"_m.{c}").alias(c) for c in carry]).withColumn("possible", F.col(score) > 1e-6)


def vertex_color_view(support: DataFrame, vertices: DataFrame) -> DataFrame:
    """Colour of each vertex from its best supporting view; unsupported vertices keep the fallback colour and view -1."""
    best = best_view(support, ["scene_id", "vid"], "score", ("r", "g", "b"))
    base = K.FALLBACK_RGB
    return vertices.select("scene_id", "vid").join(best, ["scene_id", "vid"], "left").select(
        "scene_id", "vid", F.coalesce("view_id", F.lit(-1)).alias("color_view"),
        *[F.floor(K.clip(F.coalesce(F.col(c), F.lit(float(v))), 0.0, 255.0)).cast("int").alias(c) for c, v in zip("rgb", base)])


def exposure_pairs(scores: DataFrame, least_faces: int = 200) -> DataFrame:
    """Median log light ratio of every view pair, per channel, over faces both views see well.

    The pairs of one face are the few views of its scene. Medians come from the bracketed exact quantile.
    """
    good = scores.where((F.col("score") > 0.15) & (F.least("r", "g", "b") > 15)).select(
        *FACE, "view_id", *[F.greatest(K.srgb_linear(F.col(c)), F.lit(1e-5)).alias(c) for c in "rgb"])
    other = good.select(*FACE, F.col("view_id").alias("view_j"), *[F.col(c).alias(f"_{c}") for c in "rgb"])
    both = good.withColumnRenamed("view_id", "view_i").join(other, FACE).where("view_i < view_j")
    pair = ["scene_id", "view_i", "view_j"]
    sized = both.groupBy(*pair).agg(F.count("*").alias("faces")).where(F.col("faces") >= least_faces)
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.log(F.col(f"_{c}") / F.col(c)).alias("ratio")) for c in "rgb"])
    long = both.join(sized.select(*pair), pair).select(*pair, F.inline(channels))
    med = exact_quantiles(long, [*pair, "channel"], "ratio", {"median": 0.5})
    wide = med.groupBy(*pair).agg(*[F.max(F.when(F.col("channel") == c, F.col("median"))).alias(f"log_{c}") for c in "rgb"])
    return wide.join(sized, pair)


def _solve(matrix: Column, size: int) -> Column:
    """Gauss-Jordan elimination of the augmented ``matrix`` array<array<double>> of ``size`` rows; its pivots are positive."""
    def step(m: Column, k: Column) -> Column:
        lead = F.transform(m[k], lambda v: v / m[k][k])
        return F.transform(m, lambda row, i: F.when(i == k, lead).otherwise(F.zip_with(row, lead, lambda v, p: v - row[k] * p)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, step)


def exposure_gains(pairs: DataFrame, views: DataFrame, most_views: int = 12) -> DataFrame:
    """Per-view channel gains: least squares on the pair differences with view 0 anchored at weight 10.

    A task admits 3 to 12 photos, numbered from 0; a view from ``most_views`` on is an error. The normal equations are sums
    over a scene's pairs, and the elimination is an expression over the one row that holds them. Views that no pair connects to
    view 0 get the solution of least norm, by a ridge of 1e-9. Log gains are exponentiated and clipped to .65 - 1.6; views
    without a pair keep gain 1.
    """
    n, channels = most_views, ("log_r", "log_g", "log_b")
    i, j = F.col("view_i"), F.col("view_j")
    high = F.raise_error(F.lit(f"a scene has a view above {n - 1}")).cast("int")
    p = pairs.withColumns({"view_i": F.when(F.greatest(i, j) < n, i).otherwise(high)})
    # Entries of the normal matrix and of its three right sides, summed per place.
    one = F.lit(1.0)
    places = F.array(*[F.struct(r.alias("r"), c.alias("c"), v.alias("v")) for r, c, v in (
        (i, i, one), (j, j, one), (i, j, -one), (j, i, -one), *[(i, F.lit(n + q), F.col(t)) for q, t in enumerate(channels)], *[(j, F.lit(n + q), -F.col(t)) for q, t in enumerate(channels)])])
    sums = p.select("scene_id", F.inline(places)).groupBy("scene_id", "r", "c").agg(F.sum("v").alias("v"))
    system = sums.groupBy("scene_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("r") * (n + 3) + F.col("c")).alias("at"), "v"))).alias("m"))
    start = lambda r, c: F.when(r != c, 0.0).otherwise(F.when(r == 0, 100.0 + 1e-9).otherwise(1e-9))
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(n + 2)), lambda c: start(r, c) + F.coalesce(F.try_element_at("m", r * (n + 3) + c), F.lit(0.0))))
    solved = system.select("scene_id", rows.alias("a")).select("scene_id", F.posexplode(_solve(F.col("a"), n)).alias("view_id", "row"))
    found = solved.select("scene_id", "view_id", *[F.least(F.greatest(F.exp(F.col("row")[n + q]), F.lit(0.65)), F.lit(1.6)).alias(f"gain_{c}") for q, c in enumerate("rgb")])
    met = p.select("scene_id", F.explode(F.array("view_i", "view_j")).alias("view_id")).distinct()
    found = found.join(met, ["scene_id", "view_id"], "left_semi")
    return views.select("scene_id", "view_id").join(found, ["scene_id", "view_id"], "left").na.fill(1.0, ["gain_r", "gain_g", "gain_b"])


def _with_neighbours(faces: DataFrame, adjacency: DataFrame) -> DataFrame:
    """One row per face with the list ``near`` of its neighbours; a face has at most three, since an edge joins two faces."""
    near = both_ways(adjacency).groupBy(*FACE).agg(F.sort_array(F.collect_list("neighbour")).alias("near"))
    return faces.join(near.hint("merge"), FACE, "left").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))


def _exchange(state: DataFrame, message: Column, sends: Column | None = None) -> DataFrame:
    """``state`` (scene_id, fid, s struct with ``near``) with the messages that each face's neighbours send it: scene_id, fid, s, got.

    One pass turns a row into itself and its messages, and one grouped pass brings both together: a round reads its input
    once, shuffles once and joins nothing. Rows whose ``sends`` is not true send nothing.
    """
    kind, note = state.schema["s"].dataType, state.select(message.alias("m")).schema["m"].dataType
    own = F.struct(F.col("fid"), F.col("s"), F.lit(None).cast(note).alias("m"))
    near = F.col("s.near") if sends is None else F.when(sends, F.col("s.near")).otherwise(F.array().cast("array<long>"))
    mail = F.transform(near, lambda n: F.struct(n.alias("fid"), F.lit(None).cast(kind).alias("s"), message.alias("m")))
    rows = state.select("scene_id", F.inline(F.concat(F.array(own), mail)))
    return rows.groupBy(*FACE).agg(F.first("s", ignorenulls=True).alias("s"), F.sort_array(F.collect_list("m")).alias("got")).where("s IS NOT NULL")


def smooth_labels(scores: DataFrame, adjacency: DataFrame, faces: DataFrame, rounds: int = 8) -> DataFrame:
    """Labels after synchronous rounds of score + 0.10 x (neighbours with that label).

    Only views with a score above 1e-6 compete. A face without any votes as view 0 during the rounds and becomes -1
    only afterwards. A face is one row with its scores and neighbours; a round sends labels to neighbours and is one shuffle.
    """
    own = scores.where(F.col("score") > 1e-6).groupBy(*FACE).agg(F.sort_array(F.collect_list(F.struct("view_id", "score"))).alias("views"))
    rows = _with_neighbours(faces.select(*FACE), adjacency).join(own.hint("merge"), FACE, "left")

    def best(views: Column, got: Column | None) -> Column:
        votes = (lambda v: F.lit(0)) if got is None else (lambda v: F.size(F.filter(got, lambda m: m == v)))
        top = F.array_max(F.transform(views, lambda v: F.struct((v["score"] + votes(v["view_id"]) * 0.1).alias("score"), (-v["view_id"]).alias("n"))))
        return F.coalesce(-top["n"], F.lit(0))

    state = rows.select(*FACE, F.struct("views", "near", best(F.col("views"), None).alias("label")).alias("s"))
    for _ in range(rounds):
        met = _exchange(state, F.col("s.label"))
        state = met.select(*FACE, F.struct("s.views", "s.near", best(F.col("s.views"), F.col("got")).alias("label")).alias("s"))
    return state.select(*FACE, F.when(F.col("s.views").isNull(), -1).otherwise(F.col("s.label")).alias("label"))


def _mean(channel: str) -> Column:
    return (F.aggregate("got", F.lit(0.0), lambda total, m: total + m[channel]) / F.size("got")).alias(channel)


def diffuse_fill(colors: DataFrame, adjacency: DataFrame, rounds: int = 64) -> DataFrame:
    """Give faces without a photo the mean colour of their known neighbours, round by round.

    Input (scene_id, fid, known, r, g, b). Synchronous; stops when no new face is reached; faces never reached keep
    the fallback colour. The result truncates to whole values. A face is filled in the round after its first neighbour became
    known, so only faces filled in the round before send their colour, and only faces that lacked a photo are shuffled. Eight rounds
    make one job.
    """
    rows = cut_lineage(_with_neighbours(colors.select(*FACE, "known", *[F.col(c).cast("double").alias(c) for c in "rgb"]), adjacency))
    start = rows.where("known").select(*FACE, F.lit(0).alias("step"), "r", "g", "b")
    none = [F.lit(None).cast("double").alias(c) for c in "rgb"]
    fresh = rows.where("known").select(*FACE, F.struct("near", F.lit(0).alias("step"), "r", "g", "b").alias("s"))
    waiting = rows.where("NOT known").select(*FACE, F.struct("near", F.lit(None).cast("int").alias("step"), *none).alias("s"))
    filled = []
    for first in range(1, rounds + 1, 8):
        state = waiting.unionByName(fresh)
        for turn in range(first, min(first + 8, rounds + 1)):
            met = _exchange(state, F.struct("s.r", "s.g", "s.b"), F.col("s.step") == turn - 1)
            mean = [_mean(c) for c in "rgb"]
            new = F.col("s.step").isNull() & (F.size("got") > 0)
            state = met.select(*FACE, F.when(new, F.struct("s.near", F.lit(turn).alias("step"), *mean)).otherwise(F.col("s")).alias("s"))
            if turn == first:  # faces with a photo have sent their colours
                state = state.where(F.col("s.step").isNull() | (F.col("s.step") == turn))
        done = cut_lineage(state)
        filled.append(done.where("s.step IS NOT NULL").select(*FACE, "s.step", "s.r", "s.g", "s.b"))
        last = min(first + 7, rounds)
        fresh, waiting = done.where(F.col("s.step") == last), done.where("s.step IS NULL")
        if fresh.isEmpty():
            break
    for part in filled:
        start = start.unionByName(part)
    base = K.FALLBACK_RGB
    return colors.select(*FACE).join(start.hint("merge"), FACE, "left").select(
        *FACE, F.coalesce("step", F.lit(-1)).alias("step"),
        *[F.floor(K.clip(F.coalesce(F.col(c), F.lit(float(v))), 0.0, 255.0)).cast("int").alias(c) for c, v in zip("rgb", base)])


def region_picks(scores: DataFrame, regions: DataFrame, x: Column, y: Column) -> DataFrame:
    """Scores joined with every region of their view, ``poly`` array<struct<x, y>>, that holds the place x, y.

    A polygon is only walked where its box holds the place; one with a missing corner has no box.
    """
    sides = {"x": F.transform("poly", lambda p: p["x"]), "y": F.transform("poly", lambda p: p["y"])}
    loose = F.exists("poly", lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]))
    boxed = regions.withColumns({"_loose": loose, **{f"_{n}{a}": f(v) for a, v in sides.items() for n, f in (("lo", F.array_min), ("hi", F.array_max))}})
    near = F.col("_loose") | (x.between(F.col("_lox"), F.col("_hix")) & y.between(F.col("_loy"), F.col("_hiy")))
    return scores.join(boxed, ["scene_id", "view_id"]).where(near & M.in_polygon(x, y, F.col("poly"))).drop("_loose", "_lox", "_hix", "_loy", "_hiy")


def apply_preferences(labels: DataFrame, picks: DataFrame) -> DataFrame:
    """Regional override: the last listed region whose photo scores the face above 1e-6 names its label.

    ``picks``: (scene_id, fid, region_order, view_id, score) of faces whose centre lies in a region.
    """
    override = picks.where(F.col("score") > 1e-6).groupBy(*FACE).agg(F.max_by("view_id", "region_order").alias("_o"))
    return labels.join(override, FACE, "left").select(*FACE, F.coalesce("_o", "label").alias("label"))


def with_gains(samples: DataFrame, gains: DataFrame | None, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Photo samples (scene_id, view_id and the colours ``names``) with each view's channel gains applied in linear light.

    Without ``gains``, or for a view that has none, samples stay as they are.
    """
    if gains is None:
        return samples
    sides = gains.select("scene_id", "view_id", *[F.col(f"gain_{c}").alias(f"_g{c}") for c in "rgb"])
    lit = {n: F.when(F.col(f"_g{c}").isNull(), F.col(n)).otherwise(K.srgb_encode(K.srgb_linear(F.col(n)) * F.col(f"_g{c}"))) for n, c in zip(names, "rgb")}
    return samples.join(sides, ["scene_id", "view_id"], "left").withColumns(lit).drop("_gr", "_gg", "_gb")


def faces_to_bake(uv: DataFrame, corners: DataFrame, labels: DataFrame, fallback: DataFrame) -> DataFrame:
    """Faces of the atlas with all that their texels need (``BAKED``): corners, label with its score, fill colours.

    Files of faces are far smaller than their rows: merged, never broadcast.
    """
    label = labels.where("label >= 0").select(*FACE, F.col("label").alias("want"), "score").hint("merge")
    fill = fallback.select(*FACE, *[F.col(c).alias(f"fill_{c}") for c in "rgb"]).hint("merge")
    return Z.with_sides(uv, corners).join(label, FACE, "left").join(fill, FACE, "left")


def bake_texels(texels: DataFrame, labels: DataFrame | None, fallback: DataFrame | None, views: DataFrame | None, pixels: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """Texel colour and source: the chosen view's bilinear sample where the point is valid there, else the fill.

    ``texels`` carry scene_id, tx, ty, fid; ``views`` the projected, tested texel points per view (u, v, valid,
    mask_distance, score, w, h) in the frame of ``pixels``. ``gains`` as in ``with_gains``. Photo samples round, fill colours
    are whole already. Code 0 = no photo. Without ``views``, texels are already in their face's view (nulls where it has none)
    and carry their fill_r, fill_g, fill_b: each is baked where it is.
    """
    key = ["scene_id", "tx", "ty"]
    if views is None:
        hit = with_gains(sample_bilinear_clamped(texels, pixels, ["r", "g", "b"], F.col("w"), F.col("h")), gains, ("s_r", "s_g", "s_b"))
        code = F.when(F.col("valid"), F.col("view_id") + 1).otherwise(0)
        return hit.select(*key, "fid", code.alias("source_code"), K.quality_code(code, F.col("mask_distance"), F.col("score")).alias("quality_code"),
                          *[F.when(F.col("valid"), F.rint(K.clip(F.col(f"s_{c}"), 0.0, 255.0)).cast("int")).otherwise(F.col(f"fill_{c}")).alias(c) for c in "rgb"])
    carried = [c for c in ("p_step", "p_base", "p", "p_r", "p_g", "p_b") if c in views.columns]
    seen = views.where("valid").select(*key, "view_id", "u", "v", "w", "h", "mask_distance", "score", *carried)
    seen = sample_bilinear_clamped(seen, pixels, ["r", "g", "b"], F.col("w"), F.col("h")).drop("u", "v", "w", "h", *carried)
    hit = with_gains(seen, gains, ("s_r", "s_g", "s_b"))
    hit = hit.select(*key, "view_id", (F.col("view_id") + 1).alias("_code"), "mask_distance", "score",
                     *[F.rint(K.clip(F.col(f"s_{c}"), 0.0, 255.0)).cast("int").alias(f"_{c}") for c in "rgb"])
    # Labels and fill share the faces' partitioning: texels are shuffled once by face and once by texel.
    chosen = labels.where("label >= 0").select(*FACE, F.col("label").alias("view_id"))
    out = texels.select(*key, "fid").join(chosen.hint("merge"), FACE, "left").join(fallback.select(*FACE, "r", "g", "b").hint("merge"), FACE, "left").join(hit.hint("merge"), [*key, "view_id"], "left")
    code = F.coalesce("_code", F.lit(0))
    return out.select(*key, "fid", code.alias("source_code"), K.quality_code(code, F.col("mask_distance"), F.col("score")).alias("quality_code"),
                      *[F.coalesce(f"_{c}", c).alias(c) for c in "rgb"])


def pad_texels(texels: DataFrame, width: int, height: int, pad: int = 4, single: bool = False) -> DataFrame:
    """Copy the nearest active texel into positions up to ``pad`` away; padding is marked and never counts as coverage.

    Of texels equally near, the one with the smaller row, then column, is copied. ``single`` says that a position has one texel and
    that its colours are known, as in a raster: colours then travel with the distances, and are joined to nothing.
    """
    atlas = texels.select("scene_id").distinct().select("scene_id", F.lit(0).alias("view_id"), F.lit(width).alias("w"), F.lit(height).alias("h"))
    cells = texels.select("scene_id", F.lit(0).alias("view_id"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    if single:
        rgb = [F.col(c).cast("double").alias(c) for c in "rgb"]
        found = R.distance_field(texels.select("scene_id", F.lit(0).alias("view_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), *rgb), atlas, within=pad, values=("r", "g", "b"))
        return found.select("scene_id", F.col("x").alias("tx"), F.col("y").alias("ty"), *[F.col(f"near_{c}").cast(texels.schema[c].dataType).alias(c) for c in "rgb"],
                            (F.col("distance") > 0).alias("padding"))
    near = R.distance_field(cells, atlas, within=pad).select("scene_id", F.col("x").alias("tx"), F.col("y").alias("ty"), "near_x", "near_y", (F.col("distance") > 0).alias("padding"))
    colors = texels.select("scene_id", F.col("tx").alias("near_x"), F.col("ty").alias("near_y"), "r", "g", "b")
    # The estimate of a raster's size misses its expansion: merged, so that no side passes through the driver.
    return near.join(colors.hint("merge"), ["scene_id", "near_x", "near_y"]).select("scene_id", "tx", "ty", "r", "g", "b", "padding")


def coverage_report(texels: DataFrame) -> DataFrame:
    """Active, photo-supported and filled texels per scene, and the supported share."""
    out = texels.groupBy("scene_id").agg(F.count("*").alias("active"), F.count_if(F.col("source_code") > 0).alias("supported"))
    return out.withColumn("fallback", F.col("active") - F.col("supported")).withColumn("fraction", F.col("supported") / F.col("active"))


def source_counts(texels: DataFrame) -> DataFrame:
    return texels.groupBy("scene_id", "source_code").agg(F.count("*").alias("texels"))


def face_area_coverage(best: DataFrame, metrics: DataFrame) -> DataFrame:
    """Share of the surface area whose faces have a usable view."""
    joined = metrics.select(*FACE, "area").join(best.select(*FACE, "possible"), FACE, "left")
    return joined.groupBy("scene_id").agg((F.sum(F.when(F.col("possible"), F.col("area")).otherwise(0.0)) / F.sum("area")).alias("area_fraction"))


def coverage_bounds(texels: DataFrame, metrics: DataFrame) -> DataFrame:
    """Area-weighted photo coverage; faces without any texel are unresolved and only raise the upper bound."""
    per_face = texels.groupBy(*FACE).agg(F.count("*").alias("_n"), F.count_if(F.col("source_code") > 0).alias("_p"))
    j = metrics.select(*FACE, "area").join(per_face.hint("merge"), FACE, "left")
    share = F.when(F.col("_n").isNotNull(), F.col("_p") / F.col("_n")).otherwise(0.0)
    total = F.sum("area")
    return j.groupBy("scene_id").agg((F.sum(F.col("area") * share) / total).alias("lower"),
                                     (F.sum(F.when(F.col("_n").isNull(), F.col("area")).otherwise(0.0)) / total).alias("unresolved_fraction"),
                                     F.count_if(F.col("_n").isNull()).alias("unresolved_faces")) \
        .withColumn("upper", F.col("lower") + F.col("unresolved_fraction"))


def dist_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p05, median, p95 and maximum."""
    q = exact_quantiles(df, by, value, {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return q.join(df.groupBy(*by).agg(F.max(value).alias("maximum")), by)


def uv_stretch(uv: DataFrame, corners: DataFrame, width: int, height: int) -> DataFrame:
    """Ratio of the singular values of each face's surface-to-texel map (denominator at least 1e-12), and its texel area."""
    c = F.col
    j = uv.select(*FACE, "ua", "va", "ub", "vb", "uc", "vc").join(corners, FACE)
    e1, e2 = [c(f"{a}1") - c(f"{a}0") for a in "xyz"], [c(f"{a}2") - c(f"{a}0") for a in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    j = j.withColumns({"_l": F.sqrt(dot(e1, e1)), "_d": dot(e1, e2), "_e": dot(e2, e2),
                       "_a1": (c("ub") - c("ua")) * width, "_a2": (c("vb") - c("va")) * height,
                       "_c1": (c("uc") - c("ua")) * width, "_c2": (c("vc") - c("va")) * height})
    j = j.withColumn("_x", c("_d") / c("_l")).withColumn("_y", F.sqrt(F.greatest(c("_e") - c("_x") * c("_x"), F.lit(0.0))))
    j = j.where("_l > 0 AND _y > 0").withColumns({"_j11": c("_a1") / c("_l"), "_j21": c("_a2") / c("_l")}) \
        .withColumns({"_j12": (c("_c1") - c("_j11") * c("_x")) / c("_y"), "_j22": (c("_c2") - c("_j21") * c("_x")) / c("_y")})
    s = c("_j11") * c("_j11") + c("_j12") * c("_j12") + c("_j21") * c("_j21") + c("_j22") * c("_j22")
    det = F.abs(c("_j11") * c("_j22") - c("_j12") * c("_j21"))
    root = F.sqrt(F.greatest(s * s - det * det * 4.0, F.lit(0.0)))
    j = j.withColumns({"_hi": F.sqrt((s + root) / 2), "_lo": F.sqrt(F.greatest((s - root) / 2, F.lit(0.0)))})
    return j.select(*FACE, (c("_hi") / F.greatest("_lo", F.lit(1e-12))).alias("stretch"),
                    (F.abs(c("_a1") * c("_c2") - c("_a2") * c("_c1")) / 2).alias("texel_area"))


def sampling_density(projected: DataFrame, labels: DataFrame, texel_area: DataFrame) -> DataFrame:
    """Photo pixels per atlas texel of every face in its chosen view."""
    c = F.col
    area = F.abs((c("px1") - c("px0")) * (c("py2") - c("py0")) - (c("py1") - c("py0")) * (c("px2") - c("px0"))) / 2
    picked = labels.where("label >= 0").withColumnRenamed("label", "view_id")
    return projected.join(picked, [*FACE, "view_id"]).join(texel_area.select(*FACE, "texel_area"), FACE) \
        .select(*FACE, "view_id", (area / F.nullif(c("texel_area"), F.lit(0.0))).alias("density"))


def seam_edges(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels on both sides of every shared edge; boundary = both from photos and different."""
    a = labels.select("scene_id", F.col("fid").alias("fid_a"), F.col("label").alias("label_a")).hint("merge")
    b = labels.select("scene_id", F.col("fid").alias("fid_b"), F.col("label").alias("label_b")).hint("merge")
    return adjacency.join(a, ["scene_id", "fid_a"]).join(b, ["scene_id", "fid_b"]).withColumn(
        "boundary", (F.col("label_a") >= 0) & (F.col("label_b") >= 0) & (F.col("label_a") != F.col("label_b")))


def seam_report(edges: DataFrame) -> DataFrame:
    """Edge count, mean, p95 and share above 20 of the colour jump, for all edges, photo boundaries and a reference set.

    The edges are read three times, so what is needed of them is written once.
    """
    edges = cut_lineage(edges.select("scene_id", "delta_e", "boundary", "reference"))
    scopes = F.array(F.lit("all"), F.when(F.col("boundary"), "photo-boundary"), F.when(F.col("reference"), "reference-boundary"))
    long = edges.select("scene_id", "delta_e", F.explode(scopes).alias("scope")).where("scope IS NOT NULL")
    keys = ["scene_id", "scope"]
    sums = long.groupBy(*keys).agg(F.count("*").alias("edges"), F.avg("delta_e").alias("mean"),
                                   (F.count_if(F.col("delta_e") > 20) / F.count("*")).alias("above_20"))
    return sums.join(exact_quantiles(long, keys, "delta_e", {"p95": 0.95}), keys)


def region_ssim(a: DataFrame, b: DataFrame, regions: DataFrame, channels: tuple[str, ...] = ("r", "g", "b"), win: int = 7, data_range: float = 255.0) -> DataFrame:
    """Mean structural similarity of two renderings inside fixed boxes [x0, x1) x [y0, y1): whole ``win`` windows, all channels.

    Pixels meet the boxes by an equi join on their row; every box is then a picture of its own. A pixel that a rendering
    lacks is black.
    """
    key = ["scene_id", "view_id", "x", "y"]
    pix = a.select(*key, *[F.col(c).alias(f"a{i}") for i, c in enumerate(channels)]).join(
        b.select(*key, *[F.col(c).alias(f"b{i}") for i, c in enumerate(channels)]), key, "full_outer")
    rows = regions.where("y0 < y1").select("scene_id", "view_id", "region_id", "x0", "x1", "y0", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    cut = pix.join(rows, ["scene_id", "view_id", "y"]).where("x >= x0 AND x < x1").select(
        "scene_id", F.col("region_id").alias("view_id"), (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"),
        *[F.coalesce(f"{s}{i}", F.lit(0)).cast("double").alias(f"{s}{i}") for i in range(len(channels)) for s in "ab"])
    boxes = regions.select("scene_id", F.col("region_id").alias("view_id"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    score = R.similarity(cut, boxes, len(channels), win, data_range)
    return score.groupBy("scene_id", F.col("view_id").alias("region_id")).agg(F.avg("ssim").alias("ssim"), F.count("*").alias("windows"))
