"""New-only tables, publish-last runs, meshes and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import current_run


def write_new(df: DataFrame, path: str) -> None:
    """Write a table; an existing output is an error."""
    df.write.mode("errorifexists").parquet(path)


def publish_run(tables: dict[str, DataFrame], pointer: DataFrame, root: str, run_id: str) -> None:
    """Write the immutable run tables first and append the pointer row last.

    A failure before the append leaves the former run current; the pointer is one committed file.
    """
    for name, df in tables.items():
        write_new(df, f"{root}/runs/{run_id}/{name}")
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The current run of each project."""
    return current_run(spark.read.parquet(f"{root}/pointers"))


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Mesh tables with per-row provenance; faces are laid out by class, so a class is read without the other."""
    write_new(vertices, f"{path}/vertices")
    faces.write.mode("errorifexists").partitionBy("completion").parquet(f"{path}/faces")


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object per row and line."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("errorifexists").text(path)


def write_annotations(notes: DataFrame, path: str) -> None:
    """One annotation document per scene, in a folder scene_id=<n>; ``notes`` has the document's fields beside scene_id."""
    notes.write.mode("errorifexists").partitionBy("scene_id").json(path)
