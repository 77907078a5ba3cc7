"""Artifact, source and run ledgers: verification joins, set checks, reuse decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content as C


def verify_artifacts(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Status of every manifest row: unsafe-path, missing, size-changed, hash-changed or ok."""
    found = present.select("bundle_id", "path", F.col("byte_count").alias("_bytes"), F.col("sha256").alias("_sha"))
    status = (F.when(~C.safe_path(F.col("path")), "unsafe-path").when(F.col("_sha").isNull(), "missing")
              .when(F.col("_bytes") != F.col("byte_count"), "size-changed")
              .when(F.col("_sha") != F.col("sha256"), "hash-changed").otherwise("ok"))
    return manifest.join(found, ["bundle_id", "path"], "left").withColumn("status", status).drop("_bytes", "_sha")


def drift(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Sources whose recomputed hash differs from the recorded one."""
    now = present.select("bundle_id", "path", F.col("sha256").alias("actual_sha256"))
    return recorded.join(now, ["bundle_id", "path"]).where(F.col("actual_sha256") != F.col("sha256"))


def same_sources(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """Per group: both sides have the same number of rows and the same set of keys.

    Both sides are counted per (group, key) before the join, so repeated keys cost one row each.
    """
    left = a.groupBy(group, key).agg(F.count("*").alias("_na"))
    right = b.groupBy(group, key).agg(F.count("*").alias("_nb"))
    both = left.join(right, [group, key], "full_outer")
    return both.groupBy(group).agg(
        (F.bool_and(F.col("_na").isNotNull() & F.col("_nb").isNotNull())
         & (F.coalesce(F.sum("_na"), F.lit(0)) == F.coalesce(F.sum("_nb"), F.lit(0)))).alias("same"))


def build_manifest(files: DataFrame) -> DataFrame:
    """path, byte_count, sha256 of every produced file except the resource log."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name != "resources.jsonl").select(
        "bundle_id", "path", F.octet_length("content").cast("bigint").alias("byte_count"),
        C.digest(F.col("content")).alias("sha256"))


def declared_vs_present(declared: DataFrame, present: DataFrame, *keys: str) -> DataFrame:
    """Rows on one side only: 'missing' when declared but absent, 'undeclared' when present but not listed."""
    d = declared.select(*keys).distinct().withColumn("_d", F.lit(True))
    p = present.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = d.join(p, list(keys), "full_outer")
    return both.where(F.col("_d").isNull() | F.col("_p").isNull()).select(
        *keys, F.when(F.col("_p").isNull(), "missing").otherwise("undeclared").alias("status"))


def same_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are both tables equal as multisets, and how many rows differ on each side.

    Row counts per distinct row are compared in one aggregation instead of two set differences.
    """
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("_side")).unionByName(b.select(*cols, F.lit(-1).alias("_side")))
    diff = both.groupBy(*cols).agg(F.sum("_side").alias("_d"))
    return diff.agg(F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_first"),
                    F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_second")) \
        .withColumn("same", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def use_ledger(all_photos: DataFrame, selected: DataFrame, key: str, subset: bool = True) -> DataFrame:
    """Exactly one role and reason for every input photo."""
    # Roles and reasons.
    used, kept = "geometry-and-texture", "retained-original"
    if not subset:
        return all_photos.withColumn("role", F.lit(used)).withColumn(
            "reason", F.lit("Within sparse runtime budget; all photos used"))
    hit = selected.select(key).distinct().withColumn("_hit", F.lit(True))
    chosen = F.col("_hit").isNotNull()
    return all_photos.join(hit, key, "left").withColumn("role", F.when(chosen, used).otherwise(kept)).withColumn(
        "reason", F.when(chosen, "Selected by spatial sRGB diversity within 12-photo memory budget").otherwise(
            "Outside sparse subset; original retained, no claimed geometry or texture contribution")).drop("_hit")


def coverage_check(all_rows: DataFrame, selected: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """One row: selected is inside all, and the ledger names exactly all."""
    sides = {"_all": all_rows, "_sel": selected, "_led": ledger}
    stacked = None
    for name, df in sides.items():
        part = df.select(key, *[F.lit(int(name == n)).alias(n) for n in sides])
        stacked = part if stacked is None else stacked.unionByName(part)
    keys = stacked.groupBy(key).agg(*[F.max(n).alias(n) for n in sides])
    return keys.agg(F.count_if((F.col("_sel") == 1) & (F.col("_all") == 0)).alias("selected_outside"),
                    F.count_if(F.col("_led") != F.col("_all")).alias("ledger_mismatch")) \
        .withColumn("valid", (F.col("selected_outside") == 0) & (F.col("ledger_mismatch") == 0))


def outdated(manifests: DataFrame, runs: DataFrame) -> DataFrame:
    """A project's model is outdated when its photo set or settings differ from those of the run."""
    run = runs.select("project_id", F.col("photo_ids").alias("_ids"), F.col("quality").alias("_q"),
                      F.col("object_masking").alias("_m"))
    differ = ((F.size(F.array_except("photo_ids", "_ids")) > 0) | (F.size(F.array_except("_ids", "photo_ids")) > 0)
              | (F.col("quality") != F.col("_q")) | (F.col("object_masking") != F.col("_m")))
    return manifests.join(run, "project_id", "left").withColumn(
        "outdated", F.coalesce(differ, F.lit(False))).drop("_ids", "_q", "_m")


def commit_check(runs: DataFrame, snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """Run, input snapshot and manifest agree: same project, same ids in the same order, same settings."""
    snap = snapshots.select("run_id", F.col("project_id").alias("_sp"), F.col("photo_ids").alias("_si"),
                            F.col("quality").alias("_sq"))
    man = manifests.select("project_id", F.col("photo_ids").alias("_mi"), F.col("quality").alias("_mq"))
    agree = ((F.col("_sp") == F.col("project_id")) & (F.col("_si") == F.col("_mi")) & (F.col("_sq") == F.col("_mq"))
             & (F.col("photo_ids") == F.col("_si")) & (F.col("quality") == F.col("_sq")))
    return runs.join(snap, "run_id", "left").join(man, "project_id", "left") \
        .withColumn("agrees", F.coalesce(agree, F.lit(False))).drop("_sp", "_si", "_sq", "_mi", "_mq")


def current_run(runs: DataFrame, key: str = "project_id", order: tuple[str, ...] = ("created_at", "run_id")) -> DataFrame:
    """The newest committed run of each project; one pre-aggregated maximum, no window."""
    rest = [c for c in runs.columns if c not in (key, *order)]
    best = runs.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_run"))
    return best.select(key, *[F.col(f"_run.{c}").alias(c) for c in (*order, *rest)])


def stage_signatures(checkpoints: DataFrame, identity: Column, command: Column) -> DataFrame:
    """signature = SHA-256 of (parent, command); the parent of the first stage is the job identity.

    ``checkpoints`` must carry ``job_id``, ``stage_order`` and the former stage's ``checkpoint_json``. A job has a
    handful of stages, so the window holds a handful of rows whatever the number of jobs.
    """
    by_job = Window.partitionBy("job_id").orderBy("stage_order")
    parent = F.coalesce(F.sha2(F.lag("checkpoint_json").over(by_job), 256), identity)
    return checkpoints.withColumn("_parent", parent).withColumn(
        "signature", F.sha2(F.to_json(F.struct(command.alias("command"), F.col("_parent").alias("parent"))), 256)) \
        .drop("_parent")


def reuse_plan(checkpoints: DataFrame) -> DataFrame:
    """A stage is reused only while every stage before it was valid too."""
    first_bad = checkpoints.groupBy("job_id").agg(
        F.min(F.when(~F.coalesce(F.col("valid"), F.lit(False)), F.col("stage_order"))).alias("_bad"))
    reuse = F.col("_bad").isNull() | (F.col("stage_order") < F.col("_bad"))
    return checkpoints.join(first_bad, "job_id").withColumn(
        "action", F.when(reuse, "reused").otherwise("run")).drop("_bad")


def order_artifacts(manifest: DataFrame) -> DataFrame:
    """Smallest first, path as tie break: the copy order."""
    return manifest.orderBy("byte_count", "path")


def list_drafts(manifests: DataFrame) -> DataFrame:
    """Newest first; a manifest that cannot be decoded stays listed, at the far past with no photos."""
    broken = F.col("name").isNull() | F.col("modified_at").isNull()
    # Fixed value: the far past.
    past = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    return manifests.select(
        "draft_id", F.when(broken, "Draft needs attention").otherwise(F.col("name")).alias("name"),
        F.when(broken, past).otherwise(F.col("modified_at")).alias("modified_at"),
        F.when(broken, 0).otherwise(F.col("photo_count")).alias("photo_count")) \
        .orderBy(F.col("modified_at").desc(), "draft_id")


def pose_coverage(photos: DataFrame, poses: DataFrame, issues: DataFrame) -> DataFrame:
    """Every photo with its pose status and sample issue; 'absent' when the engine never mapped it."""
    pose = poses.select("photo_id", "sample_id", F.col("located").alias("_located"))
    issue = issues.groupBy("sample_id").agg(F.max_by("issue", "seq").alias("sample_issue"))
    status = F.when(F.col("_located").isNull(), "absent").when(F.col("_located"), "located").otherwise("unlocated")
    return photos.join(pose, "photo_id", "left").join(issue, "sample_id", "left") \
        .withColumn("status", status).drop("_located")
