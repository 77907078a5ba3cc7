"""Vector matching, match residuals and diverse selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import matrices as M
from ..operators.ledger import use_ledger
from .gather import sample_nearest_clamped
from .ranking import exact_quantiles_of


#: Rows whose distances to a block are held at once, and pairs whose differences are.
STRIP, PAIRS = 512, 65536


def _two_in_block(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the two nearest vectors of ``b``, ties to the lower id, sorted by rank.

    A matrix product tells which vectors can be among the two nearest, with a margin far above its rounding; distances are
    computed for those alone. Where a value is not finite, all are.
    """
    squares, out = (b * b).sum(axis=1), []
    for first in range(0, len(a), STRIP):
        part = a[first:first + STRIP]
        with np.errstate(all="ignore"):
            own = (part * part).sum(axis=1)
            rough = own[:, None] + squares[None, :] - 2.0 * (part @ b.T)
            margin = 2e-9 * (own + squares.max())
        if np.isfinite(rough).all() and len(b) > 2:
            i, j = np.nonzero(rough <= (np.partition(rough, 1, axis=1)[:, 1] + margin)[:, None])
        else:
            i, j = (n.ravel() for n in np.indices(rough.shape))
        d = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            some = slice(at, at + PAIRS)
            d[some] = np.sqrt(((b[j[some]] - part[i[some]]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[rank < 2] + first, j[rank < 2], d[rank < 2]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _block_matcher():
    """Two nearest neighbours inside one pair of blocks, for both directions."""
    def match(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["pair_id", "side", "id", "other", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        a = np.stack(left["v"].to_numpy()).astype("float64")
        b = np.stack(right["v"].to_numpy()).astype("float64")
        out = []
        for side, ids, others, m, n in (("a", left["id"], right["id"], a, b), ("b", right["id"], left["id"], b, a)):
            ids, others = ids.to_numpy(), others.to_numpy()
            row, at, d = _two_in_block(m, n, others)
            out.append(pd.DataFrame({"pair_id": key[0], "side": side, "id": ids[row], "other": others[at], "distance": d}))
        return pd.concat(out)[names]

    return match


def two_nearest(a: DataFrame, b: DataFrame, block_rows: int = 1024, most_rows: int = 4096) -> DataFrame:
    """The two nearest vectors of the other set for every vector of both sets, exact, within each pair id.

    Input (pair_id, id, v). Each side of a pair is cut into blocks of about ``block_rows``, or an eighth of the side where that
    is more, up to ``most_rows``; one task compares one block with one block and emits two candidates per vector, so a pair of any
    size is spread over many tasks, nobody emits all distances, and a vector is sent once per block of the other side. Candidates
    of a vector are two per block and are reduced by rank.
    """
    def blocks(df: DataFrame, tag: str) -> DataFrame:
        rows = F.greatest(F.lit(block_rows), F.least(F.lit(most_rows), F.ceil(F.count("*") / 8)))
        return df.groupBy("pair_id").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"n{tag}"))

    counts = blocks(a, "a").join(blocks(b, "b"), "pair_id")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        j = df.select("pair_id", "id", "v").join(counts, "pair_id")
        j = j.withColumn(f"block_{own}", F.pmod(F.xxhash64("id"), F.col(f"n{own}")).cast("int"))
        return j.withColumn(f"block_{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))) \
            .select(*[F.col(c).alias(c) for c in ("pair_id", "block_a", "block_b", "id", "v")])

    schema = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("side", T.StringType()), T.StructField("id", T.LongType()),
                           T.StructField("other", T.LongType()), T.StructField("distance", T.DoubleType())])
    keys = ["pair_id", "block_a", "block_b"]
    found = spread(a, "a", "b").groupBy(*keys).cogroup(spread(b, "b", "a").groupBy(*keys)).applyInPandas(_block_matcher(), schema)
    rank = Window.partitionBy("pair_id", "side", "id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(rank)).where("rank <= 2")


def mutual_ratio_match(a: DataFrame, b: DataFrame, ratio: float = 0.75, block_rows: int = 1024) -> DataFrame:
    """Pairs that are each other's nearest, both clearly nearer than the second: (pair_id, id_a, id_b, distance)."""
    best = two_nearest(a, b, block_rows).groupBy("pair_id", "side", "id").agg(
        F.min(F.when(F.col("rank") == 1, F.col("other"))).alias("other"),
        F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"), F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    good = best.where(F.col("d1") < F.col("d2") * ratio)
    ahead = good.where("side = 'a'").select("pair_id", F.col("id").alias("id_a"), F.col("other").alias("id_b"), F.col("d1").alias("distance"))
    back = good.where("side = 'b'").select("pair_id", F.col("id").alias("id_b"), F.col("other").alias("id_a"))
    return ahead.join(back, ["pair_id", "id_a", "id_b"])


def pair_fundamentals(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Fundamental matrix of each (scene_id, view_a, view_b)."""
    cam = cameras.select("scene_id", "view_id", "ext", "k")
    a = cam.select("scene_id", F.col("view_id").alias("view_a"), F.col("ext").alias("ea"), F.col("k").alias("ka"))
    b = cam.select("scene_id", F.col("view_id").alias("view_b"), F.col("ext").alias("eb"), F.col("k").alias("kb"))
    joined = pairs.select("scene_id", "view_a", "view_b").distinct().join(a, ["scene_id", "view_a"]).join(b, ["scene_id", "view_b"])
    return joined.select("scene_id", "view_a", "view_b", M.fundamental(F.col("ea"), F.col("ka"), F.col("eb"), F.col("kb")).alias("f"))


def match_residuals(matches: DataFrame, cameras: DataFrame) -> DataFrame:
    """Sampson residual of every match. The matrix is built once per view pair, not per match."""
    f = pair_fundamentals(matches, cameras)
    return matches.join(f, ["scene_id", "view_a", "view_b"]).withColumn(
        "sampson", M.sampson(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"), F.col("f"))).drop("f")


def reprojection(matches: DataFrame, pixels: DataFrame, cameras: DataFrame, depth_tolerance: float | None = None) -> DataFrame:
    """World point of each match's source pixel projected into the target view, and its error there.

    With ``depth_tolerance`` only points that land on the target mask at the depth recorded there are kept.
    """
    c = F.col
    cam = cameras.select("scene_id", "view_id", "ext", "k", "w", "h")
    a = cam.select("scene_id", c("view_id").alias("view_a"), c("ext").alias("ea"), c("k").alias("ka"), c("w").alias("wa"), c("h").alias("ha"))
    b = cam.select("scene_id", c("view_id").alias("view_b"), c("ext").alias("eb"), c("k").alias("kb"), c("w"), c("h"))
    src = matches.join(a, ["scene_id", "view_a"]).withColumns({"view_id": c("view_a"), "u": c("xa"), "v": c("ya")})
    src = sample_nearest_clamped(src, pixels, {"depth": None}, c("wa"), c("ha")).where("s_depth IS NOT NULL AND s_depth > 0")
    world = M.backproject(c("xa"), c("ya"), c("s_depth"), c("ea"), c("ka"))
    src = src.select("scene_id", "view_a", "view_b", "match_id", "xb", "yb", F.inline(F.array(world)))
    out = src.join(b, ["scene_id", "view_b"])
    p = M.project(c("x"), c("y"), c("z"), c("eb"), c("kb"))
    out = out.select("scene_id", "view_a", "view_b", "match_id", "xb", "yb", "w", "h", F.inline(F.array(p.alias("p")))) \
        .withColumnRenamed("z", "z_cam")
    if depth_tolerance is not None:
        out = out.where(M.in_texture_frame(c("u"), c("v"), c("z_cam"), c("w") + 1, c("h") + 1)).withColumn("view_id", c("view_b"))
        out = sample_nearest_clamped(out, pixels.withColumn("on", c("mask").cast("int")), {"depth": None, "on": 0}, c("w"), c("h"))
        out = out.where((c("s_on") > 0) & (F.abs(c("s_depth") - c("z_cam")) < depth_tolerance)).drop("s_depth", "s_on", "view_id")
    return out.withColumns({"dx": c("u") - c("xb"), "dy": c("v") - c("yb")}).withColumn("error", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy")))


def residual_report(residuals: DataFrame) -> DataFrame:
    """Per view pair: count, median and p95 error, median signed offsets, share ahead of the camera, share of the diagonal."""
    keys = ["scene_id", "view_a", "view_b"]
    mid = exact_quantiles_of(residuals, keys, {"error": (F.col("error"), {"median_px": 0.5, "p95_px": 0.95}),
                                               "dx": (F.col("dx"), {"median_dx": 0.5}), "dy": (F.col("dy"), {"median_dy": 0.5})})
    base = residuals.groupBy(*keys).agg(F.count("*").alias("matches"), F.avg((F.col("z_cam") > 0).cast("double")).alias("ahead"),
                                        F.max(F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))).alias("_diag"))
    return base.join(mid, keys).withColumn("diagonal_share", F.col("median_px") / F.col("_diag")).drop("_diag")


def centroid(vectors: DataFrame) -> DataFrame:
    """Mean of every vector component: (pos, mean). Components are averaged before they travel."""
    return vectors.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def grid_signature(pixels: DataFrame, w: int, h: int, cells: int = 16) -> DataFrame:
    """Box-mean colour grid of every photo as (scene_id, view_id, cell, r, g, b), values 0-1."""
    cell = F.floor(F.col("y") * cells / h) * cells + F.floor(F.col("x") * cells / w)
    return pixels.groupBy("scene_id", "view_id", cell.cast("int").alias("cell")).agg(
        *[(F.avg(c) / 255.0).alias(c) for c in "rgb"])


def _nearest_of(centres: list):
    fixed = np.asarray(centres, dtype="float64")

    @F.pandas_udf("double")
    def nearest(v: pd.Series) -> pd.Series:
        m = np.stack(v.to_numpy()).astype("float64") if len(v) else np.zeros((0, fixed.shape[1]))
        best = np.full(len(m), np.inf)
        for c in fixed:
            best = np.minimum(best, ((m - c) ** 2).sum(axis=1))
        return pd.Series(best)

    return nearest(F.col("v"))


def diverse_sample(vectors: DataFrame, limit: int = 12) -> DataFrame:
    """Farthest-point subset: (key, sha256, rank). At most ``limit`` rows are all kept, in hash order.

    The first pick is nearest to the mean vector, then always the row farthest from the picks so far, ties to the lower
    hash. Every pass recomputes the distance to the few picks and keeps one pre-aggregated row, so nothing but the
    picks themselves (at most ``limit`` vectors) ever reaches the driver and no state has to survive between passes.
    """
    spark = vectors.sparkSession
    head = vectors.select("key").limit(limit + 1).count()
    if head <= limit:
        order = Window.orderBy("sha256")
        return vectors.select("key", "sha256").withColumn("rank", F.row_number().over(order) - 1)
    mean = [r["mean"] for r in centroid(vectors).orderBy("pos").collect()]
    centres, picks = [], []
    for step in range(limit):
        near = _nearest_of(centres or [mean])
        score = near if step == 0 else -near
        pool = vectors.where(~F.col("sha256").isin([p[1] for p in picks])) if picks else vectors
        best = pool.select(score.alias("s"), "sha256", "key", "v").agg(F.min(F.struct("s", "sha256", "key", "v")).alias("m")).first()["m"]
        centres.append([float(x) for x in best["v"]])
        picks.append((best["key"], best["sha256"], step))
    return spark.createDataFrame(picks, T.StructType([vectors.schema["key"], vectors.schema["sha256"], T.StructField("rank", T.IntegerType())]))


def select_and_record(vectors: DataFrame, limit: int = 12) -> DataFrame:
    """The use ledger of a farthest-point selection: one role and reason per input."""
    picked = diverse_sample(vectors, limit)
    subset = vectors.select("key").limit(limit + 1).count() > limit
    return use_ledger(vectors.select("key", "sha256"), picked, "key", subset)
