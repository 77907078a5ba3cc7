"""Mesh tables: corners, adjacency, components, compaction, smoothing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..session import cut_lineage, drop_cut
from .ranking import exact_quantiles_of, row_index


def with_corners(faces: DataFrame, vertices: DataFrame, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Add the named vertex columns of each corner as <col>0, <col>1, <col>2."""
    out = faces
    for i in range(3):
        side = vertices.select("scene_id", F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in cols])
        out = out.join(side, ["scene_id", f"v{i}"])
    return out


def face_metrics(corners: DataFrame) -> DataFrame:
    """Area, unit normal and centroid of every face."""
    xyz = [F.col(f"{a}{i}") for i in range(3) for a in "xyz"]
    return corners.withColumn("_t", M.triangle(*xyz)).select(*corners.columns, "_t.*")


def mesh_bounds(vertices: DataFrame) -> DataFrame:
    """Bounds and largest extent per scene."""
    ends = [f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return vertices.groupBy("scene_id").agg(*ends).withColumn(
        "extent", F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"]))


def face_edges(faces: DataFrame) -> DataFrame:
    """Three undirected edges per face: (scene_id, fid, va, vb) with va < vb."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("va"), F.greatest(a, b).alias("vb"))
                      for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])
    return faces.select("scene_id", "fid", F.explode(pairs).alias("_e")).select("scene_id", "fid", "_e.*")


def face_adjacency(faces: DataFrame) -> DataFrame:
    """Pairs of faces that share an edge, fid_a < fid_b.

    A surface edge has exactly two faces, so one pre-aggregated minimum and maximum per edge names the pair; an edge
    with more faces joins no pair, however many faces crowd on it.
    """
    sides = face_edges(faces).groupBy("scene_id", "va", "vb").agg(
        F.min("fid").alias("fid_a"), F.max("fid").alias("fid_b"), F.count("*").alias("_n"))
    return sides.where(F.col("_n") == 2).select("scene_id", "fid_a", "fid_b", "va", "vb")


def both_ways(adjacency: DataFrame) -> DataFrame:
    """(scene_id, fid, neighbour) in both directions."""
    ends = F.array(F.struct(F.col("fid_a").alias("fid"), F.col("fid_b").alias("neighbour")),
                   F.struct(F.col("fid_b").alias("fid"), F.col("fid_a").alias("neighbour")))
    return adjacency.select("scene_id", F.explode(ends).alias("_e")).select("scene_id", "_e.*")


def is_watertight(faces: DataFrame) -> DataFrame:
    """Per scene: every edge lies on exactly two faces."""
    counts = face_edges(faces).groupBy("scene_id", "va", "vb").agg(F.count("*").alias("_n"))
    return counts.groupBy("scene_id").agg(F.bool_and(F.col("_n") == 2).alias("watertight"), F.count("*").alias("edges"))


def vertex_normals(metrics: DataFrame) -> DataFrame:
    """Unit mean of the unit normals of the faces around each vertex."""
    spread = metrics.select("scene_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz")
    sums = spread.groupBy("scene_id", "vid").agg(*[F.sum(f"n{a}").alias(f"_{a}") for a in "xyz"])
    size = F.nullif(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z")), F.lit(0.0))
    return sums.select("scene_id", "vid", *[(F.col(f"_{a}") / size).alias(f"n{a}") for a in "xyz"])


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and, for each, the smallest node of its connected part among these edges alone."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[p], root[q])
        step = root.copy()
        for side in (root[p], root[q], p, q):
            np.minimum.at(step, side, low)
        while True:
            jump = step[step]
            if (jump == step).all():
                break
            step = jump
        if (step == root).all():
            return nodes, nodes[root]
        root = step


def _contract(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            edges = pa.Table.from_batches(held)
            scene, a, b = (edges[c].to_numpy() for c in ("scene_id", "a", "b"))
            for s in np.unique(scene):
                nodes, root = local_roots(a[scene == s], b[scene == s])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), s, np.int64)), pa.array(nodes), pa.array(root)], names=["scene_id", "node", "root"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from settle()
                held, rows = [], 0
        if rows:
            yield from settle()

    return run


def _contracted(edges: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(scene_id, node, parent) for every node of ``edges``, and the edges (scene_id, a, b) between parents that are left.

    Tasks take runs of the edges in (a, b) order, so that a node with very many edges is dealt over many tasks, and find the
    parts of ``chunk`` edges at a time. A node's parent is the least root that any of them gives it; roots that share a node,
    and a root that has a parent itself, are edges of a smaller graph.
    """
    found = cut_lineage(edges.repartitionByRange("scene_id", "a", "b").mapInArrow(_contract(chunk), "scene_id long, node long, root long"))
    parent = cut_lineage(found.groupBy("scene_id", "node").agg(F.min("root").alias("parent")))
    met = found.join(parent, ["scene_id", "node"])
    root = met.select("scene_id", F.col("root").alias("a"), F.col("parent").alias("b")).where("a <> b")
    own = parent.join(found.select("scene_id", F.col("root").alias("node")).distinct(), ["scene_id", "node"], "left_semi").select("scene_id", F.col("node").alias("a"), F.col("parent").alias("b")).where("a <> b")
    left = root.unionByName(own).select("scene_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return parent, cut_lineage(left)


def _stars(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(scene_id, node, root) of ``edges`` by alternating large-star and small-star steps until nothing changes."""
    before = None
    for _ in range(max_rounds):
        last = edges
        both = edges.unionByName(edges.select("scene_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("scene_id", "a").agg(F.least(F.min("b"), F.col("a")).alias("_m")))
        # Both sides are written tables, so adaptive execution can split a hub.
        large = both.where("b > a").join(low, ["scene_id", "a"]).select("scene_id", F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b")
        down = cut_lineage(large.select("scene_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        least = cut_lineage(down.groupBy("scene_id", "a").agg(F.min("b").alias("_m")))
        pairs = F.array(F.struct(F.col("a").alias("p"), F.col("_m").alias("q")), F.struct(F.col("b").alias("p"), F.col("_m").alias("q")))
        edges = cut_lineage(down.join(least, ["scene_id", "a"]).select("scene_id", F.explode(pairs).alias("_e"))
                            .select("scene_id", F.least("_e.p", "_e.q").alias("a"), F.greatest("_e.p", "_e.q").alias("b")).where("a <> b").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("scene_id", "a", "b").cast("decimal(38,0)")).alias("h")).first()
        for spent in (last, low, down, least):
            drop_cut(spent)
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("scene_id", F.col("b").alias("node")).agg(F.min("a").alias("root"))


def components(adjacency: DataFrame, faces: DataFrame, max_rounds: int = 60, chunk: int = 1_000_000) -> DataFrame:
    """Connected parts of the face graph: (scene_id, fid, component), component = lowest face id of the part.

    The graph is contracted, level by level: tasks settle the parts of ``chunk`` edges at a time, and only roots that several
    of them gave to one face go on. Once a level is not half as large as the one before, star steps finish the rest. The
    answers return down the levels, one join each; a level has one row per face.
    """
    edges = cut_lineage(adjacency.select("scene_id", F.least("fid_a", "fid_b").alias("a"), F.greatest("fid_a", "fid_b").alias("b")).where("a <> b").distinct())
    levels, n = [], edges.count()
    while n:
        parent, left = _contracted(edges, chunk)
        levels.append(parent)
        drop_cut(edges)
        edges, before, n = left, n, left.count()
        if n and 2 * n > before:
            levels.append(_stars(edges, max_rounds).select("scene_id", "node", F.col("root").alias("parent")))
            break
    out = None
    for parent in reversed(levels):
        if out is None:
            out = parent
        else:
            above = out.select("scene_id", F.col("node").alias("parent"), F.col("parent").alias("_up"))
            out = cut_lineage(parent.join(above, ["scene_id", "parent"], "left").select("scene_id", "node", F.coalesce("_up", "parent").alias("parent")))
    if out is None:
        return faces.select("scene_id", "fid", F.col("fid").alias("component"))
    return faces.select("scene_id", "fid").join(out.withColumnRenamed("node", "fid"), ["scene_id", "fid"], "left").select(
        "scene_id", "fid", F.coalesce("parent", "fid").alias("component"))


def rank_components(parts: DataFrame) -> DataFrame:
    """Size rank per scene, largest first, ties to the lower face id. Input (scene_id, fid, component)."""
    sizes = parts.groupBy("scene_id", "component").agg(F.count("*").alias("faces"))
    sizes = sizes.withColumn("_order", -F.col("faces"))
    return row_index(sizes, ["_order", "component"], F.struct("_order", F.floor(F.col("component") / 65536)),
                     ["scene_id"], "rank").drop("_order")


def drop_small(faces: DataFrame, parts: DataFrame, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """Faces of parts with at least ``least`` faces, and the number of removed faces per scene."""
    sizes = parts.groupBy("scene_id", "component").agg(F.count("*").alias("_n"))
    sized = parts.join(sizes, ["scene_id", "component"])
    kept = faces.join(sized.where(F.col("_n") >= least).select("scene_id", "fid", "component"), ["scene_id", "fid"])
    removed = sizes.groupBy("scene_id").agg(F.coalesce(F.sum(F.when(F.col("_n") < least, F.col("_n"))), F.lit(0)).alias("removed_faces"))
    return kept, removed


def face_support(faces: DataFrame, vertex_support: DataFrame) -> DataFrame:
    """(scene_id, fid, view_id) of the views that support all three corners."""
    spread = faces.select("scene_id", "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    hits = spread.join(vertex_support.select("scene_id", "vid", "view_id").distinct(), ["scene_id", "vid"])
    return hits.groupBy("scene_id", "fid", "view_id").agg(F.count("*").alias("_n")).where("_n = 3").drop("_n")


def with_completion(faces: DataFrame, support: DataFrame) -> DataFrame:
    """completion = no view supports the face."""
    seen = support.select("scene_id", "fid").distinct().withColumn("_seen", F.lit(True))
    return faces.drop("completion").join(seen, ["scene_id", "fid"], "left") \
        .withColumn("completion", F.col("_seen").isNull()).drop("_seen")


def component_stats(parts: DataFrame, metrics: DataFrame, support: DataFrame) -> DataFrame:
    """Faces, area, supported share, number of views with at least 10 % of the area, share of the main part's area."""
    keyed = parts.join(metrics.select("scene_id", "fid", "area"), ["scene_id", "fid"])
    seen = support.select("scene_id", "fid").distinct().withColumn("_seen", F.lit(True))
    total = keyed.join(seen, ["scene_id", "fid"], "left").groupBy("scene_id", "component").agg(
        F.count("*").alias("faces"), F.sum("area").alias("area"),
        F.coalesce(F.sum(F.when(F.col("_seen"), F.col("area"))), F.lit(0.0)).alias("_sup"))
    floor = F.greatest("area", F.lit(1e-12))
    per_view = keyed.join(support, ["scene_id", "fid"]).groupBy("scene_id", "component", "view_id").agg(F.sum("area").alias("_va"))
    strong = per_view.join(total, ["scene_id", "component"]).where(F.col("_va") / floor >= 0.1) \
        .groupBy("scene_id", "component").agg(F.count("*").alias("strong_views"))
    main = total.groupBy("scene_id").agg(F.max(F.struct("faces", (-F.col("component")).alias("id"), "area")).alias("_m"))
    return total.join(strong, ["scene_id", "component"], "left").join(main, "scene_id").select(
        "scene_id", "component", "faces", "area", (F.col("_sup") / floor).alias("supported_fraction"),
        F.coalesce("strong_views", F.lit(0)).alias("strong_views"), F.col("_m.area").alias("main_area"),
        (F.col("area") / F.greatest(F.col("_m.area"), F.lit(1e-12))).alias("relative_area"),
        (-F.col("_m.id") == F.col("component")).alias("is_main"))


def view_area_fractions(parts: DataFrame, metrics: DataFrame, support: DataFrame) -> DataFrame:
    """Share of each part's area that each view supports."""
    keyed = parts.join(metrics.select("scene_id", "fid", "area"), ["scene_id", "fid"])
    total = keyed.groupBy("scene_id", "component").agg(F.sum("area").alias("_area"))
    return keyed.join(support, ["scene_id", "fid"]).groupBy("scene_id", "component", "view_id").agg(F.sum("area").alias("_v")) \
        .join(total, ["scene_id", "component"]).select(
            "scene_id", "component", "view_id", (F.col("_v") / F.greatest("_area", F.lit(1e-12))).alias("fraction"))


def distance_to_main(part_vertices: DataFrame, cutoff: float | Column, cell: float | None = None) -> DataFrame:
    """Smallest distance from each part to the main part of its scene; null beyond ``cutoff``.

    Input (scene_id, component, is_main, x, y, z). Vertices fall into cells of the cutoff size. Cells are first
    compared by the boxes of the points in them: a pair of cells survives only if its smallest possible distance is
    not above the best largest possible distance of its part. Points are compared inside surviving pairs alone, so
    crowded regions far from the closest spot produce no point pairs.
    """
    size = F.lit(float(cell or cutoff))
    grid = {f"g{a}": F.floor(F.col(a) / size) for a in "xyz"}
    pts = part_vertices.select("scene_id", "component", "is_main", "x", "y", "z").distinct().withColumns(grid)
    box = [f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    keys = ["scene_id", "gx", "gy", "gz"]
    cells = pts.groupBy("scene_id", "component", "is_main", "gx", "gy", "gz").agg(*box)
    reach = math.ceil(float(cutoff) / float(cell or cutoff))
    span = [F.lit(d) for d in range(-reach, reach + 1)]
    main = cells.where("is_main").select("scene_id", *[F.col(f"g{a}").alias(f"m{a}") for a in "xyz"],
                                         *[F.col(f"{n}{a}").alias(f"m{n}{a}") for n in ("lo", "hi") for a in "xyz"])
    for a in "xyz":
        main = main.select("*", F.explode(F.array(*span)).alias(f"_d{a}"))
    main = main.withColumns({f"g{a}": F.col(f"m{a}") + F.col(f"_d{a}") for a in "xyz"}).drop("_dx", "_dy", "_dz")
    pairs = cells.where("NOT is_main").join(main, keys)

    def gap(a):
        return F.greatest(F.col(f"lo{a}") - F.col(f"mhi{a}"), F.col(f"mlo{a}") - F.col(f"hi{a}"), F.lit(0.0))

    def span_of(a):
        return F.greatest(F.abs(F.col(f"hi{a}") - F.col(f"mlo{a}")), F.abs(F.col(f"mhi{a}") - F.col(f"lo{a}")))

    pairs = pairs.withColumns({"_lo": sum((gap(a) * gap(a) for a in "xyz"), F.lit(0.0)),
                               "_hi": sum((span_of(a) * span_of(a) for a in "xyz"), F.lit(0.0))})
    best = pairs.groupBy("scene_id", "component").agg(F.min("_hi").alias("_best"))
    alive = pairs.join(best, ["scene_id", "component"]).where(F.col("_lo") <= F.col("_best")) \
        .select("component", *keys, "mx", "my", "mz")
    sources = pts.where("NOT is_main").select("component", *keys, "x", "y", "z")
    targets = pts.where("is_main").select("scene_id", *[F.col(f"g{a}").alias(f"m{a}") for a in "xyz"],
                                          *[F.col(a).alias(f"t{a}") for a in "xyz"])
    square = sum(((F.col(a) - F.col(f"t{a}")) * (F.col(a) - F.col(f"t{a}")) for a in "xyz"), F.lit(0.0))
    near = alive.join(sources, ["component", *keys]).join(targets, ["scene_id", "mx", "my", "mz"]) \
        .groupBy("scene_id", "component").agg(F.sqrt(F.min(square)).alias("distance")) \
        .where(F.col("distance") <= F.lit(float(cutoff)))
    parts = part_vertices.select("scene_id", "component", "is_main").distinct()
    return parts.join(near, ["scene_id", "component"], "left").withColumn(
        "distance", F.when(F.col("is_main"), F.lit(0.0)).otherwise(F.col("distance")))


def compact_mesh(faces: DataFrame, vertices: DataFrame, bucket_rows: int = 65536) -> tuple[DataFrame, DataFrame]:
    """Keep used vertices only and renumber vertices and faces 0..n-1 per scene in the old order."""
    used = faces.select("scene_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    ids = row_index(used, ["vid"], F.floor(F.col("vid") / bucket_rows), ["scene_id"], "new_vid")
    new_faces = row_index(faces, ["fid"], F.floor(F.col("fid") / bucket_rows), ["scene_id"], "new_fid")
    for i in range(3):
        new_faces = new_faces.join(ids.select("scene_id", F.col("vid").alias(f"v{i}"), F.col("new_vid").alias(f"n{i}")),
                                   ["scene_id", f"v{i}"])
    return new_faces, vertices.join(ids, ["scene_id", "vid"])


def taubin(vertices: DataFrame, edges: DataFrame, iterations: int = 3, shrink: float = 0.5, grow: float = 0.53) -> DataFrame:
    """Move every vertex towards (shrink) and then away from (grow) the mean of its neighbours, in turn.

    ``edges``: undirected (scene_id, va, vb). ``iterations`` counts single moves, so three moves are in, out, in.
    """
    ends = F.array(F.struct(F.col("va").alias("vid"), F.col("vb").alias("other")), F.struct(F.col("vb").alias("vid"), F.col("va").alias("other")))
    ways = cut_lineage(edges.select("scene_id", "va", "vb").distinct().select("scene_id", F.explode(ends).alias("_e")).select("scene_id", "_e.*"))
    out = cut_lineage(vertices.select("scene_id", "vid", "x", "y", "z"))
    for step in range(iterations):
        factor = shrink if step % 2 == 0 else -grow
        other = out.select("scene_id", F.col("vid").alias("other"), *[F.col(a).alias(f"_{a}") for a in "xyz"])
        # Summed as whole trillionths, so the mean doesn't depend on the order of the neighbours.
        whole = lambda a: F.round(F.col(f"_{a}") * 1e12).cast("decimal(38,0)")
        mean = ways.join(other, ["scene_id", "other"]).groupBy("scene_id", "vid").agg(
            *[(F.sum(whole(a)).cast("double") / F.count("*") / 1e12).alias(f"_{a}") for a in "xyz"])
        out = cut_lineage(out.join(mean, ["scene_id", "vid"], "left").select(
            "scene_id", "vid", *[(F.col(a) + F.coalesce(F.col(f"_{a}") - F.col(a), F.lit(0.0)) * factor).alias(a) for a in "xyz"]))
    return out


def uv_areas(uv: DataFrame) -> DataFrame:
    """Signed and absolute doubled UV area, and whether the face is degenerate (at most 1e-15)."""
    c = F.col
    signed = (c("ub") - c("ua")) * (c("vc") - c("va")) - (c("vb") - c("va")) * (c("uc") - c("ua"))
    return uv.withColumn("uv_signed", signed).withColumn("uv_area", F.abs("uv_signed")) \
        .withColumn("degenerate", F.col("uv_area") <= 1e-15)


def display_transform(points: DataFrame, robust: bool = False) -> DataFrame:
    """Move each scene to its centre, scale the largest side to 2 and flip y and z.

    ``robust`` uses the median and the 1-99 percentile range instead of the bounds.
    """
    if robust:
        stats = exact_quantiles_of(points, ["scene_id"], {a: (F.col(a), {f"_lo{a}": 0.01, f"_c{a}": 0.5, f"_hi{a}": 0.99}) for a in "xyz"})
    else:
        stats = points.groupBy("scene_id").agg(*[f(a).alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
        stats = stats.withColumns({f"_c{a}": (F.col(f"_lo{a}") + F.col(f"_hi{a}")) / 2 for a in "xyz"})
    stats = stats.withColumn("_s", F.lit(2.0) / F.greatest(*[F.col(f"_hi{a}") - F.col(f"_lo{a}") for a in "xyz"]))
    joined = points.join(stats, "scene_id")
    sign = {"x": 1.0, "y": -1.0, "z": -1.0}
    return joined.withColumns({f"d{a}": (F.col(a) - F.col(f"_c{a}")) * F.col("_s") * sign[a] for a in "xyz"}) \
        .drop("_s", *[f"_{n}{a}" for a in "xyz" for n in ("lo", "hi", "c")])


def split_by_class(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Learned and completed faces as two disjoint tables."""
    return faces.where(~F.col("completion")), faces.where(F.col("completion"))
