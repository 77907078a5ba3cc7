"""Files, sinks and streams."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from surfex.operators import jobs as J
from surfex.sources import readers, sinks
from surfex.streaming import events as E


def dump(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_scan_is_one_level_and_ordered(spark, tmp_path):
    (tmp_path / "b.txt").write_text("b")
    (tmp_path / "a.jpg").write_bytes(bytes.fromhex("FFD8FF"))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "c.jpg").write_text("c")
    files = readers.scan_files(spark, [str(tmp_path)])
    assert [r.name for r in files.orderBy("arrival").collect()] == ["a.jpg", "b.txt"]
    assert [r.decoded_type for r in readers.inventory_files(files).collect()] == ["public.jpeg"]


def test_manifest_versions(spark, tmp_path):
    for v in (1, 3, 9):
        dump(tmp_path / f"v{v}.json", {"formatVersion": v, "id": "p", "name": "n", "photos": [{"id": "x", "originalName": "o"}]})
    (tmp_path / "broken.json").write_text("{nope")
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_manifests(spark, str(tmp_path)).collect()}
    assert got["v1.json"].status == "ok" and got["v1.json"].formatVersion == 3 and got["v1.json"].stored_version == 1
    assert got["v1.json"].photos[0].metadata is None
    assert got["v9.json"].status == "unsupported-version" and got["broken.json"].status == "unreadable"


def test_resumed_task_must_be_equal(spark, tmp_path):
    base = {"formatVersion": 1, "jobID": "j", "photos": [{"id": "a", "name": "n", "sourcePath": "/p", "sourceSHA256": "abc"}], "allPhotos": [], "photoUse": [],
            "runtime": {"weights": "/w"}, "parameters": {"memoryGiB": 10.5, "modelSize": 518, "volumeResolution": 256, "textureSize": 4096}}
    want = readers.read_tasks(spark, dump(tmp_path / "want.json", {**base, "jobID": "other"}))
    for change, ok in (({}, True), ({"photos": []}, False), ({"parameters": {**base["parameters"], "modelSize": 392}}, False), ({"runtime": {"weights": "/x"}}, False)):
        path = dump(tmp_path / f"{len(list(tmp_path.iterdir()))}.json", {**base, **change})
        assert readers.read_tasks(spark, path, want).first().resumable is ok


def test_views_regions_margins(spark, tmp_path):
    views = readers.read_views(spark, dump(tmp_path / "d.json", {"formatVersion": 2, "records": [{"id": "a", "name": "x"}, {"id": "b", "name": "y"}]}))
    assert [(r.view_id, r.id) for r in views.orderBy("view_id").collect()] == [(0, "a"), (1, "b")]
    doc = dump(tmp_path / "r.json", {"regions": [{"id": "face", "photo": "x", "box": [1, 2, 3, 4]}], "lowerBoundaryMarginWorkingPixels": 5, "perPhotoLowerBoundaryMarginWorkingPixels": {"y": 9}})
    assert readers.read_regions(spark, doc).first().x1 == 3


def test_annotations_of_every_scene(spark, tmp_path):
    for scene, default in ((0, 5), (1, 7)):
        (tmp_path / f"scene_id={scene}").mkdir()
        dump(tmp_path / f"scene_id={scene}" / "notes.json", {"lowerBoundaryMarginWorkingPixels": default, "perPhotoLowerBoundaryMarginWorkingPixels": {"y": 9},
             "backgroundPolygons": {"x": [[[1, 2], [3, 4], [5, 6]], []]}, "instrumentSkyExclusion": {"boxes": {"y": [1, 2, 3, 4]}, "blueRedRatio": 1.5, "fullPixelMargin": 2}})
    photos = spark.createDataFrame([(s, v, n) for s in (0, 1, 2) for v, n in ((0, "x"), (1, "y"))], "scene_id long, view_id int, name string")
    margins = {(r.scene_id, r.name): r.margin for r in readers.read_margins(spark, str(tmp_path), photos).collect()}
    assert margins == {(0, "x"): 5.0, (0, "y"): 9.0, (1, "x"): 7.0, (1, "y"): 9.0}
    notes = {(r.scene_id, r.view_id): r for r in readers.read_annotations(spark, str(tmp_path), photos).collect()}
    assert len(notes) == 4 and [(p.x, p.y) for p in notes[1, 0].polygons[0]] == [(1, 2), (3, 4), (5, 6)]
    assert notes[0, 1].polygons == [] and notes[0, 0].sky_box is None and notes[0, 1].sky_box == [1, 2, 3, 4]
    assert (notes[0, 0].boundary_start, notes[0, 0].exclusion_margin, notes[1, 1].blue_red, notes[1, 1].blue_least, notes[1, 1].sky_margin) == (0.0, 0.0, 1.5, None, 2)


def test_matches_drop_unknown_and_empty(spark, tmp_path):
    doc = {"pairs": [{"names": ["x", "y"], "pointsA": [[1, 2], [3, 4]], "pointsB": [[5, 6], [7, 8]]}, {"names": ["x", "z"], "pointsA": [[1, 1]], "pointsB": [[1, 1]]},
                     {"names": ["y", "x"], "pointsA": [], "pointsB": []}]}
    views = spark.createDataFrame([("x", 0), ("y", 1)], "name string, view_id int")
    got = readers.read_matches(spark, dump(tmp_path / "m.json", doc), views).orderBy("match_id").collect()
    assert [(r.xa, r.yb) for r in got] == [(1.0, 6.0), (3.0, 8.0)]


def test_new_only_sink(spark, tmp_path):
    df = spark.range(3)
    sinks.write_new(df, str(tmp_path / "out"))
    with pytest.raises(AnalysisException):
        sinks.write_new(df, str(tmp_path / "out"))


def test_failed_publish_leaves_the_former_run_current(spark, tmp_path):
    root = str(tmp_path / "store")
    row = lambda run, day: spark.createDataFrame([(1, run, day)], "project_id long, run_id long, created_at string")
    sinks.publish_run({"a": spark.range(2)}, row(1, "2024-01-01"), root, "r1")
    with pytest.raises(AnalysisException):
        sinks.publish_run({"a": spark.range(2)}, row(2, "2024-01-02"), root, "r1")
    assert sinks.read_current(spark, root).first().run_id == 1


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [("a", i, f"2024-01-01 00:00:{i:02d}", ["stage-started", "progress", "stage-reused", "completed", "failed"][i % 5] if j else "stage-started", "fusion", None)
            for j in (0, 1) for i in range(j * 10, j * 10 + 10)]
    rows += [("b", 30 + i, f"2024-01-01 00:01:{i:02d}", "failed" if i == 7 else "progress", f"s{i}", "boom" if i == 7 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "job_id string, event_id long, ts string, event string, stage string, message string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.job_id: (r.status, r.stage) for r in E.run_to_table(E.job_state_stream(stream), "update").collect()}
    assert got == {r.job_id: (r.status, r.stage) for r in J.job_state(df).collect()}
    flags = df.select("job_id", "ts", F.lit(False).alias("cancelled"), (F.col("event") == "failed").alias("request_failed"), F.lit(True).alias("has_model"), (F.col("event") == "completed").alias("processing_complete"))
    live = stream.select("job_id", "ts", F.lit(False).alias("cancelled"), (F.col("event") == "failed").alias("request_failed"), F.lit(True).alias("has_model"), (F.col("event") == "completed").alias("processing_complete"))
    want = {r.job_id: r.outcome for r in J.session_state(flags).collect()}
    assert {r.job_id: r.outcome for r in E.run_to_table(E.session_state_stream(live), "update").collect()} == want


def test_diagnostics_are_rows_not_errors(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"protocolVersion": 1, "jobID": "j", "event": "progress", "completed": 1, "total": 2}\nTraceback: x\n{"protocolVersion": 7, "event": "e"}\n\n')
    events, diagnostics = readers.read_events(spark, str(tmp_path))
    assert events.count() == 1 and {r.diagnostic for r in diagnostics.collect()} == {"Traceback: x", '{"protocolVersion": 7, "event": "e"}'}


def feed(spark, folder, batches):
    """A stream that reads one file per micro-batch, in order."""
    import os
    import time

    schema = "job_id string, event_id long, ts timestamp, event string, stage string, message string"
    for n, rows in enumerate(batches):
        spark.createDataFrame([(j, i, __import__("datetime").datetime.fromisoformat(ts), e, s, m) for j, i, ts, e, s, m in rows], schema).coalesce(1).write.parquet(f"{folder}/part{n}")
        for f in os.listdir(f"{folder}/part{n}"):
            os.utime(f"{folder}/part{n}/{f}", (time.time() - 100 + n, time.time() - 100 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder), spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def test_several_batches_and_expiry(spark, tmp_path):
    memory = "Stage exceeded the task memory budget"
    batches = [[("a", 1, "2024-01-01T00:00:01", "stage-started", "fusion", None), ("b", 2, "2024-01-01T00:00:02", "failed", None, memory), ("c", 3, "2024-01-01T00:00:03", "failed", None, "Invalid camera")],
               [("a", 4, "2024-01-01T00:05:01", "progress", "atlas", None), ("b", 5, "2024-01-01T00:05:02", "failed", None, memory), ("c", 6, "2024-01-01T00:05:03", "completed", None, None)],
               [("a", 7, "2024-01-01T00:06:01", "completed", None, None), ("b", 8, "2024-01-01T00:06:02", "completed", None, None), ("d", 9, "2024-01-01T00:06:03", "cancelled", None, memory)],
               [("z", 10, "2024-01-02T00:00:00", "progress", "x", None)]]
    stream, table = feed(spark, str(tmp_path / "in"), batches)
    tries = sorted(map(tuple, E.run_to_table(E.attempt_stream(stream), "append").collect()))
    assert tries == sorted(map(tuple, J.attempts(table).collect()))
    assert tries == [("a", 0, 518, "completed", 0), ("b", 0, 518, "failed", 392), ("b", 1, 392, "failed", 0), ("c", 0, 518, "failed", 0), ("d", 0, 518, "cancelled", 0)]
    state = E.job_state_stream(stream, "1 minute", 60)
    got = {r.job_id: (r.status, r.stage) for r in E.latest(E.run_to_table(state, "update"), "job_id").collect()}
    assert got == {r.job_id: (r.status, r.stage) for r in J.job_state(table).collect()}
    # A day later every ended job has left the state: only the running one is there.
    progress = []
    query = state.writeStream.foreachBatch(lambda b, n: progress.append(b.count())).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 2  # its value, and no timer of an ended job
