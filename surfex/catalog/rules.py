"""Rule lists, ledgers and run records."""

from pyspark.sql import functions as F

from ..functions import content as C
from ..functions import matrices as M
from ..operators import ledger as L
from ..operators import rules as R
from . import bindings  # noqa: F401
from .registry import bind, query

bind("manifest_docs", """
SELECT o_orderkey AS project_id, CAST(CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 3 END AS INT) AS format_version,
  array(o_custkey, o_custkey + o_orderkey % 3, o_custkey + 7) AS photo_ids,
  array(concat('images/', CAST(o_custkey AS STRING)), concat('images/', CAST(o_custkey + o_orderkey % 4 AS STRING))) AS image_paths,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 41 = 1 THEN 'other/m.usdz' WHEN o_orderkey % 43 = 1 THEN 'models/../m.usdz'
    ELSE concat('models/', CAST(o_orderkey AS STRING), '.usdz') END AS model_path,
  CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderkey * 10 END AS run_id,
  CASE WHEN o_orderkey % 12 = 1 THEN NULL ELSE concat('runs/', CAST(o_orderkey AS STRING), '/inputs.json') END AS snapshot_path,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'medium' ELSE 'reduced' END AS quality, o_totalprice > 150000 AS object_masking,
  CASE WHEN o_orderkey % 29 = 2 THEN NULL ELSE concat('Draft ', o_orderpriority) END AS name, o_orderdate AS modified_at,
  CAST(o_orderkey % 9 AS INT) AS photo_count
FROM orders""")

bind("snapshots", """
SELECT concat('runs/', CAST(o_orderkey AS STRING), '/inputs.json') AS snapshot_path, o_orderkey AS snap_project_id,
  CASE WHEN o_orderkey % 17 = 4 THEN o_orderkey ELSE o_orderkey * 10 END AS snap_run_id,
  CASE WHEN o_orderkey % 19 = 4 THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'medium' ELSE 'reduced' END AS snap_quality,
  CASE WHEN o_orderkey % 23 = 4 THEN array(o_custkey, o_custkey + 7, o_custkey + o_orderkey % 3)
    ELSE array(o_custkey, o_custkey + o_orderkey % 3, o_custkey + 7) END AS snap_photo_ids
FROM orders WHERE o_orderkey % 4 <> 0""")

bind("tasks", """
SELECT o_orderkey AS job_id, CAST(CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END AS INT) AS format_version,
  CASE WHEN o_orderkey % 7 = 0 THEN array('a', 'b') ELSE array('a', CAST(o_orderkey % 11 AS STRING), 'c') END AS photo_ids,
  CASE WHEN o_orderkey % 7 = 0 THEN array('ha', 'hb') ELSE array('ha', CAST(o_custkey % 9 AS STRING), 'hc') END AS photo_hashes,
  CASE WHEN o_orderkey % 7 = 0 THEN array('a', 'b', 'd') ELSE array('a', CAST(o_orderkey % 11 AS STRING), 'c', CAST(o_orderkey % 4 AS STRING)) END AS all_ids,
  CASE WHEN o_orderkey % 7 = 0 THEN array('ha', 'hx', 'hd') ELSE array('ha', CAST(o_custkey % 9 AS STRING), 'hc', 'hd') END AS all_hashes,
  CASE WHEN o_orderkey % 5 = 0 THEN array('a', 'c') ELSE array('c', 'a', CAST(o_orderkey % 4 AS STRING), CAST(o_orderkey % 11 AS STRING)) END AS used_ids,
  o_totalprice / 4e4 AS memory_gib
FROM orders""")

bind("bundle_docs", """
SELECT o_orderkey AS bundle_id, CAST(1 + CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END AS INT) AS format_version,
  CASE WHEN o_orderkey % 47 = 0 THEN 'exact' ELSE 'approximate' END AS kind, CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'm' END AS method,
  array(CAST(o_orderkey % 5 AS STRING), CAST(o_custkey % 5 AS STRING)) AS source_hashes, array('inferred') AS limitations,
  CAST(o_custkey % 100 AS INT) AS triangle_count, CAST(o_orderkey % 60 - 2 AS INT) AS completion_count,
  array('model.usdz', CASE WHEN o_orderkey % 13 = 0 THEN 'bundle.json' WHEN o_orderkey % 13 = 1 THEN 'model.usdz' ELSE 'p.usdz' END) AS artifact_paths,
  CASE WHEN o_orderkey % 17 = 0 THEN 'model.glb' ELSE 'model.usdz' END AS model,
  CASE WHEN o_orderkey % 19 = 0 THEN 'model.usdz' WHEN o_orderkey % 19 = 1 THEN 'q.usd' ELSE 'p.usdz' END AS provenance_model
FROM orders""")


def listed(**rules):
    """DuckDB counterpart of a rule list: names of the conditions that are not true, as text."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN ({c}) IS NOT TRUE THEN '{n}' END" for n, c in rules.items()) + ")"


def named(df, key):
    return df.select(key, F.concat_ws(",", "violations").alias("violations"))


def rule_sql(source, key, **rules):
    return f"SELECT * FROM (SELECT {key}, {listed(**rules)} AS violations FROM {source}) WHERE violations <> ''"


def unique(a):
    return f"len(list_distinct({a})) = len({a})"


def safe(p):
    return f"{p} <> '' AND {p} NOT LIKE '/%' AND NOT list_contains(string_split({p}, '/'), '..')"


def subset(a, b):
    return f"list_has_all({b}, {a})"


@query("f6_resource_failure", """SELECT event_id, coalesce(s = 'resource-limit', false) OR contains(lower(coalesce(e, '')), 'outofmemoryerror')
  OR contains(lower(coalesce(e, '')), 'mps backend out of memory') OR contains(lower(coalesce(e, '')), 'defaultcpuallocator: can''t allocate memory')
  OR coalesce(contains(message, 'memory budget'), false) AS resource_failure FROM (
SELECT event_id, message, CASE WHEN event_id % 6 = 0 THEN 'resource-limit' ELSE event END AS s,
  CASE event_id % 5 WHEN 0 THEN 'OutOfMemoryError(x)' WHEN 1 THEN 'MPS backend out of memory (8 GB)'
   WHEN 2 THEN 'DefaultCPUAllocator: can''t allocate memory' WHEN 3 THEN NULL ELSE 'No space left on device' END AS e FROM job_events)""")
def _(t):
    k = F.col("event_id") % 5
    error = F.when(k == 0, "OutOfMemoryError(x)").when(k == 1, "MPS backend out of memory (8 GB)") \
        .when(k == 2, "DefaultCPUAllocator: can't allocate memory").when(k == 4, "No space left on device")
    status = F.when(F.col("event_id") % 6 == 0, "resource-limit").otherwise(F.col("event"))
    return t.job_events.select("event_id", C.resource_failure(status, error, F.col("message")).alias("resource_failure"))


_STAGES = "CASE coalesce(stage, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.STAGE_TEXT.items()) + f" ELSE '{C.STAGE_TEXT_OTHER}' END"


@query("f7_stage_label", f"""SELECT event_id, CASE WHEN event IN ('stage-started','stage-reused','progress') THEN {_STAGES}
 || CASE WHEN total IS NOT NULL THEN concat('（', completed, '/', total, '）') ELSE '' END || CASE WHEN event = 'stage-reused' THEN ' · 已恢复' ELSE '' END END AS label FROM job_events""")
def _(t):
    return t.job_events.select("event_id", C.stage_label(F.col("event"), F.col("stage"), F.col("completed"), F.col("total")).alias("label"))


LIMITS = {"supported": True, "max_images": 6, "max_dimension": 8000}


@query("f50_preflight", """SELECT project_id, photos, oversize, CASE
 WHEN photos < 3 THEN concat('Add at least ', 3 - photos, ' more overlapping ', CASE WHEN photos = 2 THEN 'photo' ELSE 'photos' END, ' to start. A complete object usually needs many more.')
 WHEN photos > 6 THEN concat('This Mac supports at most 6 photos per session. Remove ', photos - 6, ' photos from the input list to continue.')
 WHEN oversize > 0 THEN concat(oversize, CASE WHEN oversize = 1 THEN ' photo exceeds' ELSE ' photos exceed' END, ' this Mac''s size limit. Remove the marked photos from the input list to continue.') END AS reason
FROM (SELECT n.n_nationkey::BIGINT AS project_id, count(p.photo_id) AS photos, count(*) FILTER (greatest(pixel_width, pixel_height) > 8000) AS oversize
 FROM nation n LEFT JOIN photos p ON n.n_nationkey = p.project_id GROUP BY 1)""")
def _(t):
    projects = t.nation.select(F.col("n_nationkey").cast("bigint").alias("project_id"))
    return R.preflight(t.photos, LIMITS, projects)


@query("f50_photo_issues", """SELECT project_id, photo_id, 'This photo exceeds this Mac''s limit of 8000 pixels per side.' AS issue FROM photos WHERE greatest(pixel_width, pixel_height) > 8000""")
def _(t):
    return R.photo_issues(t.photos, 8000)


@query("f51_route", """SELECT project_id, CASE WHEN photos < 3 THEN 'blocked' WHEN photos <= 12 THEN 'sparse' WHEN NOT capable THEN 'sparse-subset'
 WHEN outcome = 'computational-failure' THEN 'sparse-fallback' WHEN outcome = 'saving-failure' THEN 'failed' WHEN outcome = 'cancelled' THEN 'cancelled' ELSE 'conventional' END AS route
FROM (SELECT o_custkey AS project_id, count(*) AS photos, max(o_totalprice) < 490000 AS capable,
 CASE o_custkey % 5 WHEN 0 THEN 'computational-failure' WHEN 1 THEN 'saving-failure' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'completed' END AS outcome FROM orders GROUP BY o_custkey)""")
def _(t):
    k = F.col("project_id") % 5
    counts = t.orders.groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.count("*").alias("photos"), (F.max("o_totalprice") < 490000).alias("capable"))
    outcome = F.when(k == 0, "computational-failure").when(k == 1, "saving-failure").when(k == 2, "cancelled").when(k == 3, "completed")
    return R.route(counts.withColumn("outcome", outcome)).select("project_id", "route")


@query("f52_photo_violations", rule_sql("photos", "photo_id",
       image_path=f"image_path LIKE 'images/%' AND {safe('image_path')}", thumbnail_path=f"thumbnail_path LIKE 'thumbnails/%' AND {safe('thumbnail_path')}",
       pixel_size="pixel_width > 0 AND pixel_height > 0", orientation="orientation BETWEEN 1 AND 8", primary_image="primary_image_index >= 0",
       byte_count="byte_count > 0", type_identifier="type_identifier <> ''", digest="regexp_full_match(content_sha256, '[0-9a-f]{64}')"))
def _(t):
    return named(R.photo_violations(t.photos), "photo_id")


@query("f53_manifest_violations", rule_sql("(SELECT m.*, s.snap_project_id, s.snap_run_id, s.snap_quality, s.snap_photo_ids FROM manifest_docs m LEFT JOIN snapshots s ON m.snapshot_path = s.snapshot_path)", "project_id",
       version="format_version = 3", unique_photo_ids=unique("photo_ids"), unique_paths=unique("image_paths"),
       model_path=f"model_path IS NULL OR (model_path LIKE 'models/%' AND model_path LIKE '%.usdz' AND {safe('model_path')})",
       run_reference="model_path IS NULL OR (run_id IS NOT NULL) = (snapshot_path IS NOT NULL)",
       snapshot_agrees="model_path IS NULL OR run_id IS NULL OR snapshot_path IS NULL OR (snap_project_id = project_id AND snap_run_id = run_id AND snap_quality = quality AND snap_photo_ids = photo_ids)"))
def _(t):
    return named(R.manifest_violations(t.manifest_docs.withColumn("model_photo_ids", F.col("photo_ids")), t.snapshots), "project_id")


def _staged(t):
    plan = R.staging_plan(t.photos)
    spoilt = lambda rule: F.col("photo_id") % 13 == _SPOILT[rule]
    change = lambda rule, column, to: F.when(spoilt(rule), to).otherwise(F.col(column))
    return plan.withColumn("run_id", F.col("project_id")).withColumn(
        "staged_path", F.concat(F.lit("cache/"), F.when(spoilt("staged_path"), "x").otherwise(F.col("project_id").cast("string")), F.lit("/input/"),
                                F.col("photo_id").cast("string"), F.when(F.col("operation") == "tiff-to-png", ".png").otherwise(".jpg"))) \
        .withColumn("input_sha256", F.when(spoilt("content"), F.sha2(F.lit("changed"), 256)).when(spoilt("input_digest"), "none").otherwise(F.col("content_sha256"))) \
        .withColumns({"recipe_version": change("known_recipe", "recipe_version", F.lit(7)), "input_width": change("size", "input_width", F.col("input_width") + 1),
                      "input_orientation": change("orientation", "input_orientation", F.col("input_orientation") + 1),
                      "original_to_input": change("transform", "original_to_input", M.vector(2, 0, 0, 0, 1, 0, 0, 0, 1)),
                      "color_policy": change("color_policy", "color_policy", F.lit("none")), "input_type": change("type", "input_type", F.lit("public.data"))})


_ORIENT = """CASE orientation WHEN 1 THEN [1,0,0,0,1,0,0,0,1] WHEN 2 THEN [-1,0,w-1,0,1,0,0,0,1] WHEN 3 THEN [-1,0,w-1,0,-1,h-1,0,0,1]
 WHEN 4 THEN [1,0,0,0,-1,h-1,0,0,1] WHEN 5 THEN [0,1,0,1,0,0,0,0,1] WHEN 6 THEN [0,-1,h-1,1,0,0,0,0,1] WHEN 7 THEN [0,-1,h-1,-1,0,w-1,0,0,1]
 WHEN 8 THEN [0,1,0,-1,0,w-1,0,0,1] END::DOUBLE[]"""

#: Which recorded recipes the binding spoils, by photo_id modulo 13: one way for each of the nine rules that can fail.
_SPOILT = {"known_recipe": 1, "staged_path": 2, "input_digest": 3, "size": 4, "orientation": 5, "transform": 6, "color_policy": 7, "content": 8, "type": 9}


@query("f54_recipe_violations", rule_sql("(SELECT *, photo_id % 13 AS odd, regexp_full_match(content_sha256, '[0-9a-f]{64}') AS valid, type_identifier = 'public.tiff' AS tiff FROM photos)", "photo_id",
       known_recipe="odd <> 1", staged_path="odd <> 2", input_digest="valid AND odd <> 3",
       size="CASE WHEN tiff AND odd = 1 AND orientation >= 5 THEN pixel_width = pixel_height ELSE odd <> 4 END", orientation="CASE WHEN tiff AND odd = 1 THEN orientation = 1 ELSE odd <> 5 END",
       transform="CASE WHEN tiff AND odd = 1 THEN orientation = 1 WHEN tiff THEN orientation BETWEEN 1 AND 8 AND odd <> 6 ELSE odd <> 6 END",
       color_policy="CASE WHEN tiff AND odd = 1 THEN false ELSE odd <> 7 END", content="(tiff AND odd <> 1) OR odd NOT IN (3, 8)",
       type="CASE WHEN tiff AND odd = 1 THEN false ELSE odd <> 9 END"))
def _(t):
    return named(R.recipe_violations(_staged(t)), "photo_id")


@query("f55_staging_plan", f"""SELECT photo_id, CASE WHEN tiff THEN 'tiff-to-png' ELSE 'original-file' END AS operation, CASE WHEN tiff AND orientation >= 5 THEN h ELSE w END AS input_width,
 CASE WHEN tiff AND orientation >= 5 THEN w ELSE h END AS input_height, CASE WHEN tiff THEN 1 ELSE orientation END AS input_orientation,
 m[1] AS m0, m[2] AS m1, m[3] AS m2, m[4] AS m3, m[5] AS m4, m[6] AS m5
 FROM (SELECT *, CASE WHEN tiff THEN {_ORIENT} ELSE [1,0,0,0,1,0,0,0,1]::DOUBLE[] END AS m FROM (SELECT *, pixel_width AS w, pixel_height AS h, type_identifier = 'public.tiff' AS tiff FROM photos))""")
def _(t):
    m = F.col("original_to_input")
    return R.staging_plan(t.photos).select("photo_id", "operation", "input_width", "input_height", "input_orientation", *[m[i].alias(f"m{i}") for i in range(6)])


@query("f56_task_violations", rule_sql("tasks", "job_id", version="format_version = 1", photo_count="len(photo_ids) BETWEEN 3 AND 12",
       unique_photos=f"{unique('photo_ids')} AND {unique('photo_hashes')}", unique_inputs=f"{unique('all_ids')} AND {unique('all_hashes')}",
       selected_from_inputs=subset("list_transform(list_zip(photo_ids, photo_hashes), lambda e: concat(e[1], '|', e[2]))", "list_transform(list_zip(all_ids, all_hashes), lambda e: concat(e[1], '|', e[2]))"),
       every_input_has_a_use=f"len(all_ids) <= len(photo_ids) OR ({subset('used_ids', 'all_ids')} AND {subset('all_ids', 'used_ids')})", memory="memory_gib BETWEEN 2 AND 11"))
def _(t):
    return named(R.task_violations(t.tasks), "job_id")


@query("f57_bundle_violations", rule_sql("bundle_docs", "bundle_id", version="format_version = 1", kind="kind = 'approximate'", method="method <> ''", sources="len(source_hashes) > 0",
       limitations="len(limitations) > 0", triangles="triangle_count > 0", completion_range="completion_count BETWEEN 0 AND triangle_count", unique_sources=unique("source_hashes"),
       unique_paths=unique("artifact_paths"), no_self_reference="NOT list_contains(artifact_paths, 'bundle.json')", model_suffix="model LIKE '%.usdz'",
       provenance_suffix="provenance_model LIKE '%.usdz'", distinct_models="model <> provenance_model", model_listed="list_contains(artifact_paths, model)",
       provenance_listed="list_contains(artifact_paths, provenance_model)"))
def _(t):
    return named(R.bundle_violations(t.bundle_docs), "bundle_id")


@query("f58_session_outcome", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'cancelled' WHEN message IS NOT NULL THEN 'failed' WHEN event = 'completed' AND stage IS NOT NULL THEN 'completed' ELSE 'incomplete' END AS outcome FROM job_events""")
def _(t):
    return t.job_events.select("event_id", R.session_outcome(F.col("event_id") % 5 == 0, F.col("message"), F.col("event") == "completed", F.col("stage")).alias("outcome"))


_BOTH = """manifest AS (SELECT bundle_id, path, byte_count, sha256(content) AS sha256 FROM manifest_rows),
present AS (SELECT bundle_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS byte_count, sha256(content) AS sha256 FROM present_rows)"""


def _manifest(t):
    return t.manifest_rows.select("bundle_id", "path", "byte_count", C.digest(F.col("content")).alias("sha256"))


def _present(t):
    return t.present_rows.select("bundle_id", "path", F.octet_length("content").cast("bigint").alias("byte_count"), C.digest(F.col("content")).alias("sha256"))


@query("j1_verify_artifacts", f"""WITH {_BOTH} SELECT m.path, CASE WHEN NOT ({safe('m.path')}) THEN 'unsafe-path' WHEN p.sha256 IS NULL THEN 'missing'
 WHEN p.byte_count <> m.byte_count THEN 'size-changed' WHEN p.sha256 <> m.sha256 THEN 'hash-changed' ELSE 'ok' END AS status
 FROM manifest m LEFT JOIN present p ON m.path = p.path""")
def _(t):
    return L.verify_artifacts(_manifest(t), _present(t)).select("path", "status")


@query("j3_source_drift", f"WITH {_BOTH} SELECT m.path, m.sha256, p.sha256 AS actual_sha256 FROM manifest m JOIN present p ON m.path = p.path WHERE m.sha256 <> p.sha256")
def _(t):
    return L.drift(_manifest(t), _present(t)).select("path", "sha256", "actual_sha256")


@query("j4_same_sources", f"""WITH {_BOTH}, s AS (SELECT DISTINCT bundle_id FROM manifest)
SELECT s.bundle_id, (SELECT count(*) FROM manifest m WHERE m.bundle_id = s.bundle_id) = (SELECT count(*) FROM present p WHERE p.bundle_id = s.bundle_id)
 AND (SELECT count(*) FROM (SELECT sha256 FROM manifest m WHERE m.bundle_id = s.bundle_id EXCEPT SELECT sha256 FROM present p WHERE p.bundle_id = s.bundle_id)) = 0 AS same FROM s""")
def _(t):
    return L.same_sources(_manifest(t), _present(t), "bundle_id", "sha256")


@query("g28_build_manifest", "SELECT bundle_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS byte_count, sha256(content) AS sha256 FROM manifest_rows")
def _(t):
    return L.build_manifest(t.manifest_rows)


@query("u6_declared_vs_present", f"""WITH d AS (SELECT path FROM manifest_rows), p AS (SELECT replace(path, 'src1', 'srcX') AS path FROM present_rows)
SELECT path, 'missing' AS status FROM (SELECT path FROM d EXCEPT SELECT path FROM p) UNION ALL SELECT path, 'undeclared' AS status FROM (SELECT path FROM p EXCEPT SELECT path FROM d)""")
def _(t):
    present = t.present_rows.select(F.replace(F.col("path"), F.lit("src1"), F.lit("srcX")).alias("path"))
    return L.declared_vs_present(t.manifest_rows, present, "path")


@query("u7_same_table", f"""WITH {_BOTH}, a AS (SELECT path, sha256 FROM manifest EXCEPT ALL SELECT path, sha256 FROM present), b AS (SELECT path, sha256 FROM present EXCEPT ALL SELECT path, sha256 FROM manifest)
SELECT (SELECT count(*) FROM a) AS only_first, (SELECT count(*) FROM b) AS only_second, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) = 0 AS same""")
def _(t):
    return L.same_table(_manifest(t).select("path", "sha256"), _present(t).select("path", "sha256"))


@query("u4_outdated", """SELECT m.project_id, coalesce(NOT list_has_all(m.photo_ids, s.snap_photo_ids) OR NOT list_has_all(s.snap_photo_ids, m.photo_ids) OR m.quality <> s.snap_quality, false) AS outdated
FROM manifest_docs m LEFT JOIN snapshots s ON s.snap_project_id = m.project_id""")
def _(t):
    runs = t.snapshots.join(t.manifest_docs.select(F.col("project_id").alias("snap_project_id"), "object_masking"), "snap_project_id") \
        .select(F.col("snap_project_id").alias("project_id"), F.col("snap_photo_ids").alias("photo_ids"), F.col("snap_quality").alias("quality"), "object_masking")
    return L.outdated(t.manifest_docs, runs).select("project_id", "outdated")


@query("j19_commit_check", """SELECT m.project_id * 10 AS run_id, coalesce(s.snap_project_id = m.project_id AND s.snap_photo_ids = m.photo_ids AND s.snap_quality = m.quality, false) AS agrees
FROM manifest_docs m LEFT JOIN snapshots s ON s.snap_run_id = m.project_id * 10""")
def _(t):
    runs = t.manifest_docs.select((F.col("project_id") * 10).alias("run_id"), "project_id", "photo_ids", "quality")
    snaps = t.snapshots.select(F.col("snap_run_id").alias("run_id"), F.col("snap_project_id").alias("project_id"),
                               F.col("snap_photo_ids").alias("photo_ids"), F.col("snap_quality").alias("quality"))
    return L.commit_check(runs, snaps, t.manifest_docs).select("run_id", "agrees")


@query("k2_current_run", "SELECT project_id, run_id, created_at, quality, object_masking FROM runs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) = 1")
def _(t):
    return L.current_run(t.runs)


@query("w8_stage_signatures", """WITH c AS (SELECT job_id, stage_order, command_id, lag(concat('{"stage":', stage_order, ',"command":', command_id, '}')) OVER (PARTITION BY job_id ORDER BY stage_order) AS prev FROM checkpoints)
SELECT job_id, stage_order, sha256(concat('{"command":"', command_id, '","parent":"', coalesce(sha256(prev), sha256(job_id::VARCHAR)), '"}')) AS signature FROM c""")
def _(t):
    rows = t.checkpoints.withColumn("checkpoint_json", F.to_json(F.struct(F.col("stage_order").alias("stage"), F.col("command_id").alias("command"))))
    return L.stage_signatures(rows, F.sha2(F.col("job_id").cast("string"), 256), F.col("command_id").cast("string")).select("job_id", "stage_order", "signature")


@query("w9_reuse_plan", """SELECT job_id, stage_order, CASE WHEN bool_and(valid) OVER (PARTITION BY job_id ORDER BY stage_order) THEN 'reused' ELSE 'run' END AS action FROM checkpoints""")
def _(t):
    return L.reuse_plan(t.checkpoints).select("job_id", "stage_order", "action")


@query("t2_list_drafts", """SELECT project_id AS draft_id, CASE WHEN name IS NULL THEN 'Draft needs attention' ELSE name END AS name,
 CASE WHEN name IS NULL THEN -62135596800 ELSE CAST(epoch(modified_at) AS BIGINT) END AS modified_at, CASE WHEN name IS NULL THEN 0 ELSE photo_count END AS photo_count FROM manifest_docs""")
def _(t):
    return L.list_drafts(t.manifest_docs.withColumnRenamed("project_id", "draft_id")).withColumn(
        "modified_at", F.unix_seconds(F.col("modified_at").cast("timestamp")))


@query("t3_order_artifacts", "SELECT path, byte_count FROM manifest_rows ORDER BY byte_count, path")
def _(t):
    return L.order_artifacts(t.manifest_rows.select("path", "byte_count"))


@query("j16_pose_coverage", """WITH issues AS (SELECT sample_id, arg_max(issue, seq) AS sample_issue FROM sample_issues GROUP BY 1)
SELECT p.photo_id, CASE WHEN q.located IS NULL THEN 'absent' WHEN q.located THEN 'located' ELSE 'unlocated' END AS status, i.sample_issue
FROM photos p LEFT JOIN poses q ON p.photo_id = q.photo_id LEFT JOIN issues i ON q.sample_id = i.sample_id""")
def _(t):
    return L.pose_coverage(t.photos, t.poses, t.sample_issues).select("photo_id", "status", "sample_issue")
