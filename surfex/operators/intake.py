"""Photo intake: inventory, classification, first-wins duplicates, issue counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import content as C

# Issue kinds in reporting order.
ISSUE_KINDS = ("duplicate", "unsupported", "unreadable", "ignored")


def inventory(files: DataFrame) -> DataFrame:
    """Replace the content bytes by digest and size, so that nothing later shuffles photo bytes."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, C.digest(F.col("content")).alias("content_sha256"),
                        F.octet_length("content").cast("bigint").alias("byte_count"))


def format_problem(name: Column, suffix: Column, decoded: Column, image_count: Column,
                   regular: Column | None = None) -> Column:
    """Kind of the first intake rule a file breaks, before duplicates are considered; null when it passes.

    The decoded type decides; the suffix only explains files nothing can decode.
    """
    suffix = F.lower(suffix)
    hidden = name.startswith(".") if regular is None else name.startswith(".") | ~regular
    return (F.when(hidden, "ignored")
            .when(decoded.isNull() & suffix.isin(*C.RAW_SUFFIXES), "unsupported")
            .when(decoded.isNull() & suffix.isin(*C.IMAGE_SUFFIXES), "unreadable")
            .when(decoded.isNull(), "ignored")
            .when(~decoded.isin(*C.ACCEPTED_TYPES), "unsupported")
            .when(~decoded.isin(*C.HEIF_TYPES) & (image_count != 1), "unsupported"))


def mark_first(df: DataFrame, key: str, order: str, flag: str, among: Column | None = None) -> DataFrame:
    """Add ``flag``: the row is the earliest of its key (among rows where ``among`` holds).

    ``order`` is unique. The minima are pre-aggregated before the shuffle and joined back by ``order``, not by the key,
    so a key that holds most rows neither gathers in one window task nor in one join task.
    """
    candidate = F.col(order) if among is None else F.when(among, F.col(order))
    first = df.groupBy(key).agg(F.min(candidate).alias("_first")).where(F.col("_first").isNotNull()).select("_first")
    return df.join(first, F.col(order) == F.col("_first"), "left").withColumn(flag, F.col("_first").isNotNull()).drop("_first")


def dedupe_first(df: DataFrame, key: str = "content_sha256", order: str = "arrival") -> DataFrame:
    """First arrival of each key is kept, later ones are marked ``duplicate``."""
    marked = mark_first(df, key, order, "_kept")
    return marked.withColumn("kind", F.when(~F.col("_kept"), "duplicate")).drop("_kept")


def new_content(inv: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose content the catalogue does not hold yet."""
    return inv.join(catalog.select("content_sha256").distinct(), "content_sha256", "left_anti")


def classify_intake(inv: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row per file with ``kind`` (null = accepted).

    Order of the rules: path already seen, hidden or not regular, not decodable, unsupported type, several images,
    content already known. A digest becomes known only when an earlier file with it was accepted.
    """
    df = mark_first(inv, "path", "arrival", "_new_path")
    df = df.withColumn("_problem", format_problem(F.col("name"), F.col("suffix"), F.col("decoded_type"),
                                                  F.col("image_count")))
    if catalog is None:
        df = df.withColumn("_known", F.lit(False))
    else:
        known = catalog.select("content_sha256").distinct().withColumn("_hit", F.lit(True))
        df = df.join(known, "content_sha256", "left").withColumn("_known", F.col("_hit").isNotNull()).drop("_hit")
    eligible = F.col("_new_path") & F.col("_problem").isNull() & ~F.col("_known")
    df = mark_first(df, "content_sha256", "arrival", "_kept", eligible)
    kind = (F.when(~F.col("_new_path"), "duplicate").when(F.col("_problem").isNotNull(), F.col("_problem"))
            .when(F.col("_kept"), F.lit(None)).otherwise("duplicate"))
    return df.withColumn("kind", kind).drop("_new_path", "_problem", "_known", "_kept")


def issue_counts(classified: DataFrame) -> DataFrame:
    """Issues per kind; accepted files are no issue."""
    return classified.where(F.col("kind").isNotNull()).groupBy("kind").agg(F.count("*").alias("issues"))


def import_summary(classified: DataFrame, *by: str) -> DataFrame:
    """'Added N photos' followed by the non-zero kinds in reporting order."""
    counts = classified.groupBy(*by).agg(
        F.count_if(F.col("kind").isNull()).alias("_added"),
        *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ISSUE_KINDS])
    parts = [F.concat(F.lit("Added "), F.col("_added").cast("string"), F.lit(" photos"))]
    parts += [F.when(F.col(f"_{k}") > 0, F.concat(F.col(f"_{k}").cast("string"), F.lit(f" {k}"))) for k in ISSUE_KINDS]
    return counts.select(*by, F.concat_ws(" · ", *parts).alias("summary"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
