"""Text, digest and rule-text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes (hex) of each container and the type name they stand for.
MAGIC_PREFIXES = (
    ("FFD8FF", "public.jpeg"),
    ("89504E470D0A1A0A", "public.png"),
    ("49492A00", "public.tiff"),
    ("4D4D002A", "public.tiff"),
    ("474946383761", "com.compuserve.gif"),
    ("474946383961", "com.compuserve.gif"),
)
# ISO base media brands.
HEIC_BRANDS = ("heic", "heix", "hevc", "hevx")
HEIF_BRANDS = ("mif1", "msf1", "heif")
ACCEPTED_TYPES = ("public.jpeg", "public.heic", "public.heif", "public.png", "public.tiff")
HEIF_TYPES = ("public.heic", "public.heif")
RAW_SUFFIXES = ("dng", "raw", "cr2", "cr3", "nef", "nrw", "arw", "sr2", "srf", "srw", "raf", "rw2", "orf", "pef", "3fr", "iiq", "rwl")
IMAGE_SUFFIXES = ("jpg", "jpeg", "heic", "heif", "png", "tif", "tiff", "gif", "bmp", "webp")

# Allocator phrases that mark a resource failure.
ALLOCATOR_PHRASES = ("outofmemoryerror", "mps backend out of memory", "defaultcpuallocator: can't allocate memory")

# The text shown for each stage.
STAGE_TEXT = {
    "prepare": "准备照片并识别主体…",
    "inference": "分析照片之间的关系…",
    "fusion": "生成主体形状…",
    "unwrap": "展开模型表面…",
    "atlas": "展开模型表面…",
    "texture": "铺设原照片纹理…",
    "package": "整理模型与来源记录…",
}
STAGE_TEXT_OTHER = "正在生成模型…"
STAGE_RECOVERED = " · 已恢复"


def digest(content: Column) -> Column:
    """Lower-case hex SHA-256 of the bytes."""
    return F.sha2(content, 256)


def valid_digest(col: Column) -> Column:
    """True for exactly 64 characters of 0-9a-f; null counts as invalid."""
    return F.coalesce(col.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def safe_path(col: Column) -> Column:
    """Non-empty, relative, and without a ``..`` segment."""
    inside = (col != "") & ~col.startswith("/") & ~F.array_contains(F.split(col, "/"), "..")
    return F.coalesce(inside, F.lit(False))


def fingerprint(*cols: str) -> Column:
    """SHA-256 of the compact JSON of the named columns, keys in name order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def decoded_type(content: Column, suffix: Column) -> Column:
    """Container type from the leading bytes; null when no decoder would recognise it.

    Camera raw files reuse the TIFF header, so a raw suffix on a TIFF header names the raw type.
    """
    head = F.hex(F.substring(content, 1, 12))
    brand = F.substring(content, 9, 4).cast("string")
    ftyp = F.substring(content, 5, 4).cast("string") == "ftyp"
    is_tiff = head.startswith("49492A00") | head.startswith("4D4D002A")
    out = F.when(is_tiff & F.lower(suffix).isin(*RAW_SUFFIXES), "com.adobe.raw-image")
    for prefix, name in MAGIC_PREFIXES:
        out = out.when(head.startswith(prefix), name)
    return out.when(ftyp & brand.isin(*HEIC_BRANDS), "public.heic").when(ftyp & brand.isin(*HEIF_BRANDS), "public.heif")


def resource_failure(status: Column, error: Column, message: Column) -> Column:
    """A failure caused by memory limits, which alone allows the lower-resolution retry."""
    lowered = F.lower(F.coalesce(error, F.lit("")))
    hit = F.coalesce(status == "resource-limit", F.lit(False))
    for phrase in ALLOCATOR_PHRASES:
        hit = hit | F.contains(lowered, F.lit(phrase))
    return hit | F.coalesce(F.contains(message, F.lit("memory budget")), F.lit(False))


def stage_label(event: Column, stage: Column, completed: Column, total: Column) -> Column:
    """Text of a stage event; null for events that carry no stage text."""
    table = F.create_map(*[F.lit(x) for kv in STAGE_TEXT.items() for x in kv])
    text = F.coalesce(F.try_element_at(table, F.coalesce(stage, F.lit(""))), F.lit(STAGE_TEXT_OTHER))
    count = F.when(completed.isNotNull() & total.isNotNull(),
                   F.concat(F.lit("（"), completed.cast("string"), F.lit("/"), total.cast("string"), F.lit("）")))
    again = F.when(event == "stage-reused", F.lit(STAGE_RECOVERED))
    shown = F.concat(text, F.coalesce(count, F.lit("")), F.coalesce(again, F.lit("")))
    return F.when(event.isin("stage-started", "stage-reused", "progress"), shown)
