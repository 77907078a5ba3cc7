"""Golden values on hand-made tables."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from surfex.functions import content as C
from surfex.functions import matrices as M
from surfex.operators import intake as I
from surfex.operators import mesh as H
from surfex.operators import ranking as K
from surfex.operators import raster as Z
from surfex.operators import rules as R
from surfex.operators import texture as X


def test_raster_keeps_the_nearest_surface(spark):
    tri = [(0, 0, 2., 2., 2., 10., 2., 2., 2., 10., 2.), (0, 1, 2., 2., 1., 10., 2., 1., 2., 10., 1.)]
    cols = ["scene_id", "fid"] + [f"p{a}{i}" for i in range(3) for a in "xyz"]
    out = {(r.x, r.y): r for r in Z.rasterize(spark.createDataFrame(tri, cols), ["scene_id"], F.lit(14), F.lit(14)).collect()}
    hit = out[(4, 4)]
    assert hit.fid == 1 and hit.z == pytest.approx(1) and (hit.b0, hit.b1) == (pytest.approx(.5), pytest.approx(.25))
    assert (13, 13) not in out


def test_equal_depth_goes_to_the_lower_face(spark):
    tri = [(0, f, 0., 0., 1., 4., 0., 1., 0., 4., 1.) for f in (9, 3, 5)]
    cols = ["scene_id", "fid"] + [f"p{a}{i}" for i in range(3) for a in "xyz"]
    out = Z.rasterize(spark.createDataFrame(tri, cols), ["scene_id"], F.lit(8), F.lit(8)).collect()
    assert {r.fid for r in out} == {3}


def test_full_intrinsics_round_trip(spark):
    rows = [(1600, 1200, 5712, 4284), (1200, 1600, 4284, 5712)]
    df = spark.createDataFrame(rows, "w int, h int, fw int, fh int")
    k = M.vector(370, 0, 259, 0, 369, 259, 0, 0, 1)
    out = df.select("*", M.letterbox(F.col("w"), F.col("h"), 518)["transform"].alias("t")).withColumn(
        "f", M.full_intrinsics(k, F.col("t"), F.col("w"), F.col("h"), F.col("fw"), F.col("fh"))).collect()
    for r in out:
        f, t = np.array(r.f).reshape(3, 3), np.array(r.t).reshape(3, 3)
        for p in ([.12, .08, .8], [-.2, -.1, 1.4]):
            q = f @ np.array(p)
            work = (q[:2] / q[2] + .5) * [r.w / r.fw, r.h / r.fh] - .5
            want = np.array([[370, 0, 259], [0, 369, 259], [0, 0, 1.]]) @ np.array(p)
            assert np.allclose((t @ [*work, 1])[:2], (want / want[2])[:2], atol=4e-5)


def test_visibility_respects_each_photos_extent(spark):
    pts = spark.createDataFrame([(1400., 900., 1.), (900., 1400., 1.)], "u double, v double, z double")
    for w, h, expected in ((1600, 1200, [True, False]), (1200, 1600, [False, True])):
        got = pts.select(M.in_texture_frame(F.col("u"), F.col("v"), F.col("z"), F.lit(w), F.lit(h)).alias("ok")).collect()
        assert [r.ok for r in got] == expected


def test_component_retention_table(spark):
    base = dict(rank=1, distance=.04, spacing=.003, area=.2, main_area=4., main_extent=1., supported_fraction=1., strong_views=2)
    cases = [base, {**base, "strong_views": 1}, {**base, "area": .002}, {**base, "distance": .4}, {**base, "supported_fraction": 0., "strong_views": 0}]
    df = spark.createDataFrame([{**c, "case": i} for i, c in enumerate(cases)])
    got = {r.case: (r.retained, r.reason) for r in R.retain_components(df).collect()}
    assert got[0] == (True, "substantial-multiview-part")
    assert not any(got[i][0] for i in range(1, 5))


def test_resource_failure_table(spark):
    rows = [("resource-limit", None, True), ("failed", "RuntimeError('MPS backend out of memory (MPS allocated: 8 GB)')", True),
            ("failed", "OutOfMemoryError('allocation failed')", True), ("failed", "RuntimeError('DefaultCPUAllocator: can't allocate memory')", True),
            ("inference-complete", None, False), ("failed", "No space left on device", False), ("failed", "Checkpoint SHA-256 mismatch", False),
            ("failed", "Invalid camera matrix", False)]
    df = spark.createDataFrame(rows, "status string, error string, want boolean")
    assert df.where(C.resource_failure(F.col("status"), F.col("error"), F.lit(None).cast("string")) != F.col("want")).count() == 0


def test_mixed_selection(spark):
    jpeg, broken = bytes.fromhex("FFD8FF") + b"a", b"not a photo"
    files = [(0, "d1/a.jpg", "a.jpg", "jpg", jpeg), (1, "d2/a.jpg", "a.jpg", "jpg", jpeg + b"2"), (2, "d1/a.jpg", "a.jpg", "jpg", jpeg),
             (3, "broken.jpg", "broken.jpg", "jpg", broken), (4, "notes.txt", "notes.txt", "txt", broken)]
    df = spark.createDataFrame(files, "arrival int, path string, name string, suffix string, content binary") \
        .withColumn("decoded_type", C.decoded_type(F.col("content"), F.col("suffix"))).withColumn("image_count", F.lit(1))
    got = I.classify_intake(I.inventory(df))
    assert {r.arrival: r.kind for r in got.collect()} == {0: None, 1: None, 2: "duplicate", 3: "unreadable", 4: "ignored"}
    assert I.import_summary(got).first().summary == "Added 2 photos · 1 duplicate · 1 unreadable · 1 ignored"


def test_content_beats_the_suffix(spark):
    jpeg, tiff = bytes.fromhex("FFD8FF") + b"a", bytes.fromhex("49492A00") + b"raw"
    heic = b"\x00\x00\x00\x18ftypheic" + b"x"
    files = [(0, "photo.unknown", "unknown", jpeg), (1, "same.heic", "heic", jpeg), (2, "raw.dng", "dng", tiff), (3, "clip.mov", "mov", b"zzz"),
             (4, "deep.bin", "bin", heic), (5, ".hidden.jpg", "jpg", jpeg + b"9")]
    df = spark.createDataFrame(files, "arrival int, name string, suffix string, content binary").withColumn("path", F.col("name")) \
        .withColumn("decoded_type", C.decoded_type(F.col("content"), F.col("suffix"))).withColumn("image_count", F.lit(1))
    got = {r.name: r.kind for r in I.classify_intake(I.inventory(df)).collect()}
    assert got == {"photo.unknown": None, "same.heic": "duplicate", "raw.dng": "unsupported", "clip.mov": "ignored", "deep.bin": None, ".hidden.jpg": "ignored"}


@pytest.mark.parametrize("count", range(7))
def test_preflight_counts(spark, count):
    projects = spark.createDataFrame([(1,)], "project_id long")
    photos = spark.createDataFrame([(1, i, 64, 48) for i in range(count)], "project_id long, photo_id int, pixel_width int, pixel_height int")
    reason = R.preflight(photos, {"supported": True, "max_images": 5, "max_dimension": 64}, projects).first().reason
    assert (reason is None) == (3 <= count <= 5)
    if count < 3:
        assert f"Add at least {3 - count} more" in reason
    if count == 6:
        assert "at most 5" in reason


def test_oversize_photos_are_named(spark):
    photos = spark.createDataFrame([(1, 0, 64, 64), (1, 1, 65, 48), (1, 2, 48, 65)], "project_id long, photo_id int, pixel_width int, pixel_height int")
    assert "2 photos exceed" in R.preflight(photos, {"max_images": 5, "max_dimension": 64}).first().reason
    assert {r.photo_id for r in R.photo_issues(photos, 64).collect()} == {1, 2}


def test_session_outcomes(spark):
    rows = [("u", None, False, False, "incomplete"), ("u", None, True, False, "completed"), ("u", None, True, True, "cancelled"),
            ("u", "disk full", True, False, "failed"), (None, None, True, False, "incomplete")]
    df = spark.createDataFrame(rows, "url string, failure string, done boolean, cancelled boolean, want string")
    assert df.where(R.session_outcome(F.col("cancelled"), F.col("failure"), F.col("done"), F.col("url")) != F.col("want")).count() == 0


def test_exact_quantiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in np.r_[rng.exponential(size=9000) ** 6, np.repeat(2.5, 4000)]] + [("s", 1.), ("s", 2.), ("t", 7.)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in K.exact_quantiles(df, ["g"], "v", {"a": .05, "b": .5, "c": .95, "d": 1.}).collect()}
    for g in ("hot", "s", "t"):
        vals = [v for k, v in data if k == g]
        assert [got[g].a, got[g].b, got[g].c, got[g].d] == pytest.approx(list(np.percentile(vals, [5, 50, 95, 100])), rel=1e-12)


def test_components_of_a_long_chain(spark):
    n = 300
    adj = spark.createDataFrame([(0, i, i + 1, 0, 0) for i in range(n - 1) if i != 120], "scene_id long, fid_a long, fid_b long, va long, vb long")
    faces = spark.createDataFrame([(0, i) for i in range(n + 1)], "scene_id long, fid long")
    got = {r.fid: r.component for r in H.components(adj, faces).collect()}
    assert all(got[i] == (0 if i <= 120 else 121) for i in range(n)) and got[n] == n


def test_gains_match_the_dense_least_squares(spark):
    rng = np.random.default_rng(1)
    pairs = [(0, 0, 1), (0, 1, 2), (0, 0, 2)]
    vals = rng.normal(size=(3, 3)) * .1
    df = spark.createDataFrame([(*p, *map(float, v)) for p, v in zip(pairs, vals)], "scene_id long, view_i int, view_j int, log_r double, log_g double, log_b double")
    views = spark.createDataFrame([(0, i) for i in range(4)], "scene_id long, view_id int")
    design = np.array([[1, -1, 0], [0, 1, -1], [1, 0, -1], [10, 0, 0]], float)
    want = np.clip(np.exp(np.linalg.lstsq(design, np.vstack([vals, np.zeros(3)]), rcond=None)[0]), .65, 1.6)
    got = {r.view_id: [r.gain_r, r.gain_g, r.gain_b] for r in X.exposure_gains(df, views).collect()}
    assert np.allclose([got[i] for i in range(3)], want) and got[3] == [1., 1., 1.]


def test_fill_never_marks_unreached_faces(spark):
    colors = spark.createDataFrame([(0, 0, True, 10., 20., 30.), (0, 1, False, None, None, None), (0, 2, False, None, None, None), (0, 3, False, None, None, None)],
                                   "scene_id long, fid long, known boolean, r double, g double, b double")
    adj = spark.createDataFrame([(0, 0, 1, 0, 0), (0, 1, 2, 0, 0)], "scene_id long, fid_a long, fid_b long, va long, vb long")
    got = {r.fid: (r.step, r.r) for r in X.diffuse_fill(colors, adj).collect()}
    assert got == {0: (0, 10), 1: (1, 10), 2: (2, 10), 3: (-1, 145)}
