"""Intake, digests and issue reports over the documents."""

from pyspark.sql import functions as F

from ..functions import content as C
from ..operators import intake as I
from . import bindings  # noqa: F401
from .registry import query

INV = """inv AS (SELECT *, sha256(content) AS content_sha256, CAST(octet_length(encode(content)) AS BIGINT) AS byte_count FROM files),
known AS (SELECT DISTINCT sha256(content) AS content_sha256 FROM catalog)"""

LADDER = f"""CASE WHEN name LIKE '.%' THEN 'ignored'
 WHEN decoded_type IS NULL AND lower(suffix) IN ({', '.join(repr(s) for s in C.RAW_SUFFIXES)}) THEN 'unsupported'
 WHEN decoded_type IS NULL AND lower(suffix) IN ('jpg','jpeg','heic','heif','png','tif','tiff','gif','bmp','webp') THEN 'unreadable'
 WHEN decoded_type IS NULL THEN 'ignored'
 WHEN decoded_type NOT IN ('public.jpeg','public.heic','public.heif','public.png','public.tiff') THEN 'unsupported'
 WHEN decoded_type NOT IN ('public.heic','public.heif') AND image_count <> 1 THEN 'unsupported' END"""

CLASSIFIED = f"""{INV},
step1 AS (SELECT i.*, i.arrival = min(i.arrival) OVER (PARTITION BY path) AS new_path, {LADDER} AS problem,
  k.content_sha256 IS NOT NULL AS is_known FROM inv i LEFT JOIN known k ON i.content_sha256 = k.content_sha256),
step2 AS (SELECT *, new_path AND problem IS NULL AND NOT is_known AS eligible FROM step1),
step3 AS (SELECT *, min(CASE WHEN eligible THEN arrival END) OVER (PARTITION BY content_sha256) AS first_ok FROM step2),
classified AS (SELECT arrival, content_sha256, byte_count, CASE WHEN NOT new_path THEN 'duplicate' WHEN problem IS NOT NULL THEN problem
  WHEN eligible AND arrival = first_ok THEN NULL ELSE 'duplicate' END AS kind FROM step3)"""


def _catalog(t):
    return t.catalog.select(C.digest(F.col("content")).alias("content_sha256"))


def _classified(t):
    return I.classify_intake(I.inventory(t.files), _catalog(t))


@query("f1_content_digest", f"WITH {INV} SELECT arrival, content_sha256 FROM inv")
def _(t):
    return I.inventory(t.files).select("arrival", "content_sha256")


@query("s2_content_inventory", f"WITH {INV} SELECT name, decoded_type, byte_count, content_sha256, image_count FROM inv WHERE decoded_type IS NOT NULL")
def _(t):
    return I.inventory(t.files).where(F.col("decoded_type").isNotNull()).select(
        "name", "decoded_type", "byte_count", "content_sha256", "image_count")


@query("f2_valid_digest", """SELECT doc_id, length(d) = 64 AND regexp_full_match(d, '[0-9a-f]*') AS valid FROM (
 SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(sha256(text)) WHEN doc_id % 5 = 0 THEN left(sha256(text), 63) ELSE sha256(text) END AS d FROM documents)""")
def _(t):
    d = C.digest(F.col("text"))
    col = F.when(F.col("doc_id") % 7 == 0, F.upper(d)).when(F.col("doc_id") % 5 == 0, F.left(d, F.lit(63))).otherwise(d)
    return t.documents.select("doc_id", C.valid_digest(col).alias("valid"))


@query("f3_safe_path", """SELECT page_id, p <> '' AND p NOT LIKE '/%' AND NOT list_contains(string_split(p, '/'), '..') AS safe FROM (
 SELECT page_id, CASE page_id % 4 WHEN 0 THEN substring(url, 8) WHEN 1 THEN concat('/', url) WHEN 2 THEN concat('a/../', url) ELSE '' END AS p FROM pages)""")
def _(t):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.substr(F.col("url"), F.lit(8))).when(k == 1, F.concat(F.lit("/"), "url")) \
        .when(k == 2, F.concat(F.lit("a/../"), "url")).otherwise("")
    return t.pages.select("page_id", C.safe_path(path).alias("safe"))


@query("f4_classify_intake", f"WITH {CLASSIFIED} SELECT arrival, kind FROM classified")
def _(t):
    return _classified(t).select("arrival", "kind")


@query("f5_fingerprint", """SELECT vec_id, sha256(concat('{"label":', label, ',"vec_id":', vec_id, '}')) AS fingerprint FROM embeddings""")
def _(t):
    return t.embeddings.select("vec_id", C.fingerprint("vec_id", "label").alias("fingerprint"))


@query("f8_import_summary", f"""WITH {CLASSIFIED}, n AS (SELECT count(*) FILTER (kind IS NULL) AS a, count(*) FILTER (kind = 'duplicate') AS d,
 count(*) FILTER (kind = 'unsupported') AS u, count(*) FILTER (kind = 'unreadable') AS r, count(*) FILTER (kind = 'ignored') AS g FROM classified)
SELECT concat_ws(' · ', concat('Added ', a, ' photos'), CASE WHEN d > 0 THEN concat(d, ' duplicate') END, CASE WHEN u > 0 THEN concat(u, ' unsupported') END,
 CASE WHEN r > 0 THEN concat(r, ' unreadable') END, CASE WHEN g > 0 THEN concat(g, ' ignored') END) AS summary FROM n""")
def _(t):
    return I.import_summary(_classified(t))


@query("g1_issue_counts", f"WITH {CLASSIFIED} SELECT kind, count(*) AS issues FROM classified WHERE kind IS NOT NULL GROUP BY kind")
def _(t):
    return I.issue_counts(_classified(t))


@query("w1_dedupe_first", f"""WITH {INV} SELECT arrival, CASE WHEN arrival <> min(arrival) OVER (PARTITION BY content_sha256) THEN 'duplicate' END AS kind FROM inv""")
def _(t):
    return I.dedupe_first(I.inventory(t.files)).select("arrival", "kind")


@query("j2_new_content", f"WITH {INV} SELECT arrival, content_sha256 FROM inv WHERE content_sha256 NOT IN (SELECT content_sha256 FROM known)")
def _(t):
    return I.new_content(I.inventory(t.files), _catalog(t)).select("arrival", "content_sha256")


@query("g33_duplicates", "SELECT sha256(text) AS content_sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return I.duplicates(t.documents.select(C.digest(F.col("text")).alias("content_sha256")), "content_sha256")
