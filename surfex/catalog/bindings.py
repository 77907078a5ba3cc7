"""Operator inputs derived from the test tables; every text is valid Spark SQL and DuckDB SQL.

Everything is keyed by ``scene_id`` (ten suppliers make one scene), so each input grows with the tables. Sums are
taken over integers and divided once, which makes both engines start from bit-identical doubles.
"""

from .registry import bind

# Photo intake: documents stand in for files.
bind("files", """
SELECT doc_id AS arrival,
  concat('sel/', CAST(CASE WHEN doc_id % 29 = 1 THEN doc_id - 1 ELSE doc_id END AS STRING)) AS path,
  concat(CASE WHEN doc_id % 23 = 5 THEN '.' ELSE '' END, source, '-', CAST(doc_id AS STRING)) AS name,
  text AS content,
  CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'heic' WHEN 2 THEN 'txt' WHEN 3 THEN 'dng' ELSE 'PNG' END AS suffix,
  CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'public.jpeg' WHEN doc_id % 5 = 1 THEN 'public.heic'
       WHEN doc_id % 5 = 4 AND doc_id % 7 = 0 THEN 'com.compuserve.gif' WHEN doc_id % 5 = 4 THEN 'public.png'
       ELSE NULL END AS decoded_type,
  CAST(CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS INT) AS image_count
FROM documents""")

# The catalogue already holds the contents of the labelled low-quality documents.
bind("catalog", """
SELECT d.doc_id AS photo_id, d.text AS content FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality = 0""")

bind("manifest_rows", """
SELECT CAST(doc_id % 50 AS BIGINT) AS bundle_id,
  concat(CASE WHEN doc_id % 31 = 3 THEN '../' ELSE '' END, source, '/', CAST(doc_id AS STRING)) AS path,
  text AS content, CAST(length(text) AS BIGINT) AS byte_count FROM documents""")

bind("present_rows", """
SELECT bundle_id, path, CASE WHEN byte_count % 17 = 0 THEN concat(content, 'x')
  WHEN byte_count % 13 = 0 THEN concat('x', substring(content, 2)) ELSE content END AS content
FROM manifest_rows WHERE byte_count % 11 <> 0""")

# Photos: one per supplier, grouped into projects of a nation; sizes and orientations from account balances.
bind("photos", """
SELECT CAST(s_nationkey AS BIGINT) AS project_id, s_suppkey AS photo_id,
  concat('images/', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 4 = 0 THEN '.tiff' ELSE '.jpg' END) AS image_path,
  concat(CASE WHEN s_suppkey % 17 = 2 THEN 'thumb/' ELSE 'thumbnails/' END, CAST(s_suppkey AS STRING), '.jpg') AS thumbnail_path,
  CAST(100 + floor(abs(s_acctbal)) AS INT) AS pixel_width, CAST(100 + s_suppkey % 900 AS INT) AS pixel_height,
  CAST(s_suppkey % 10 AS INT) AS orientation,
  CASE WHEN s_suppkey % 4 = 0 THEN 'public.tiff' ELSE 'public.jpeg' END AS type_identifier,
  CAST(s_suppkey % 13 - 1 AS INT) AS primary_image_index,
  CAST(CASE WHEN s_suppkey % 19 = 7 THEN 0 ELSE 1000 + s_suppkey END AS BIGINT) AS byte_count,
  sha2(CASE WHEN s_suppkey % 23 = 9 THEN 'same' ELSE s_name END, 256) AS content_sha256
FROM supplier""")

# Cameras: five exact rotations per scene, focal length varies by scene.
bind("cameras", """
SELECT scene_id, view_id,
  CASE view_id WHEN 0 THEN array(1e0,0e0,0e0,0e0, 0e0,1e0,0e0,0e0, 0e0,0e0,1e0,4e0)
   WHEN 1 THEN array(8e-1,0e0,6e-1,0e0, 0e0,1e0,0e0,0e0, -6e-1,0e0,8e-1,4e0)
   WHEN 2 THEN array(8e-1,0e0,-6e-1,0e0, 0e0,1e0,0e0,0e0, 6e-1,0e0,8e-1,4e0)
   WHEN 3 THEN array(1e0,0e0,0e0,0e0, 0e0,8e-1,6e-1,0e0, 0e0,-6e-1,8e-1,4e0)
   ELSE array(1e0,0e0,0e0,0e0, 0e0,8e-1,-6e-1,0e0, 0e0,6e-1,8e-1,4e0) END AS ext,
  array(focal,0e0,195e-1, 0e0,focal,145e-1, 0e0,0e0,1e0) AS k, CAST(40 AS INT) AS w, CAST(30 AS INT) AS h
FROM (SELECT DISTINCT CAST(floor(s_suppkey / 10) AS BIGINT) AS scene_id, CAST(s_suppkey % 5 AS INT) AS view_id,
  7013e-2 + floor(s_suppkey / 10) % 3 AS focal FROM supplier) c""", stored=True)

# Pixels of every view.
bind("pixels", """
SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS scene_id, CAST(l_suppkey % 5 AS INT) AS view_id,
  CAST(l_partkey % 40 AS INT) AS x, CAST(l_orderkey % 30 AS INT) AS y,
  sum(CAST(l_quantity AS BIGINT)) * 5e0 / count(*) AS r,
  sum(CAST(round(l_discount * 100) AS BIGINT)) * 255e-1 / count(*) AS g,
  sum(CAST(round(l_tax * 100) AS BIGINT)) * 31875e-3 / count(*) AS b,
  sum(CAST(l_quantity AS BIGINT)) % 4 <> 0 AS mask,
  395e-2 + sum(CAST(round(l_discount * 100) AS BIGINT)) / (1e2 * count(*)) AS depth,
  1e0 + sum(CAST(round(l_tax * 100) AS BIGINT)) * 5e-1 / count(*) AS confidence,
  CAST(sum(CAST(l_quantity AS BIGINT)) % 5 AS INT) AS label
FROM lineitem GROUP BY 1, 2, 3, 4""", stored=True)

# The photos at twice the size, with grey masks, and cameras that know both sizes.
bind("full_pixels", """
SELECT scene_id, view_id, x * 2 + dx AS x, y * 2 + dy AS y, r + dx * 3e0 AS r, g - dy * g / 64 AS g, b, CASE WHEN mask THEN 255e0 ELSE 100e0 END AS level
FROM (SELECT *, CAST(0 AS INT) AS dx, CAST(0 AS INT) AS dy FROM pixels UNION ALL SELECT *, CAST(1 AS INT) AS dx, CAST(0 AS INT) AS dy FROM pixels
  UNION ALL SELECT *, CAST(0 AS INT) AS dx, CAST(1 AS INT) AS dy FROM pixels UNION ALL SELECT *, CAST(1 AS INT) AS dx, CAST(1 AS INT) AS dy FROM pixels) q""")
bind("studio_cameras", """
SELECT scene_id, view_id, ext, k, w, h, array((7013e-2 + scene_id % 3) * 2, 0e0, 395e-1, 0e0, (7013e-2 + scene_id % 3) * 2, 295e-1, 0e0, 0e0, 1e0) AS full_k,
  CAST(80 AS INT) AS full_w, CAST(60 AS INT) AS full_h FROM cameras""")

# A second rendering of the same views: the rows of even line numbers.
bind("pixels_b", """
SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS scene_id, CAST(l_suppkey % 5 AS INT) AS view_id,
  CAST(l_partkey % 40 AS INT) AS x, CAST(l_orderkey % 30 AS INT) AS y,
  sum(CAST(l_quantity AS BIGINT)) * 5e0 / count(*) AS r,
  sum(CAST(round(l_discount * 100) AS BIGINT)) * 255e-1 / count(*) AS g,
  sum(CAST(round(l_tax * 100) AS BIGINT)) * 31875e-3 / count(*) AS b,
  sum(CAST(l_quantity AS BIGINT)) % 3 <> 0 AS mask
FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, 3, 4""", stored=True)

# Lattice mesh of every scene.
bind("vertices", """
SELECT scene_id, CAST(i * 11 + j AS BIGINT) AS vid, (i - 255e-1) / 25e0 AS x, (j - 5e0) / 8e0 AS y,
  (cents / (n * 1e7) - 5e-1) / 713e-2 AS z
FROM (SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS scene_id, CAST(l_quantity AS INT) AS i,
  CAST(round(l_discount * 100) AS INT) AS j, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3) g""", stored=True)

# Two triangles per lattice cell whose corners all exist.
bind("corners", """
SELECT f.scene_id, f.fid, f.fid % 7 = 3 AS completion, f.v0, f.v1, f.v2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1,
  c.x AS x2, c.y AS y2, c.z AS z2
FROM (SELECT scene_id, CAST((floor(vid / 11) * 10 + vid % 11) * 2 AS BIGINT) AS fid, vid AS v0, vid + 11 AS v1, vid + 1 AS v2
      FROM vertices WHERE vid % 11 < 10 AND vid < 550
      UNION ALL
      SELECT scene_id, CAST((floor(vid / 11) * 10 + vid % 11) * 2 + 1 AS BIGINT) AS fid, vid + 11 AS v0, vid + 12 AS v1, vid + 1 AS v2
      FROM vertices WHERE vid % 11 < 10 AND vid < 550) f
JOIN vertices a ON f.scene_id * 1000 + f.v0 = a.scene_id * 1000 + a.vid
JOIN vertices b ON f.scene_id * 1000 + f.v1 = b.scene_id * 1000 + b.vid
JOIN vertices c ON f.scene_id * 1000 + f.v2 = c.scene_id * 1000 + c.vid""", stored=True)

bind("faces", "SELECT scene_id, fid, v0, v1, v2, completion FROM corners")

# Broken surface with many parts: faces whose corners lie high on average.
bind("faces_kept", """
SELECT scene_id, fid, v0, v1, v2, completion FROM corners WHERE z0 + z1 + z2 > 15e-3""")

bind("half_edges", """
SELECT scene_id, fid, least(v0, v1) AS va, greatest(v0, v1) AS vb FROM faces UNION ALL
SELECT scene_id, fid, least(v1, v2) AS va, greatest(v1, v2) AS vb FROM faces UNION ALL
SELECT scene_id, fid, least(v2, v0) AS va, greatest(v2, v0) AS vb FROM faces""")

bind("adjacency", """
SELECT p.scene_id, p.fid AS fid_a, q.fid AS fid_b, p.va, p.vb FROM half_edges p JOIN half_edges q
ON (p.scene_id * 1000 + p.va) * 1000 + p.vb = (q.scene_id * 1000 + q.va) * 1000 + q.vb AND p.fid < q.fid""", stored=True)

# Scores and colours of every face in every view that shows it: the face reads one pixel per view.
bind("face_scores", """
SELECT f.scene_id, f.fid, p.view_id, CASE WHEN p.mask THEN p.r / 250e0 ELSE 0e0 END AS score, p.r, p.g, p.b
FROM faces f JOIN pixels p ON f.scene_id * 1200 + f.fid = p.scene_id * 1200 + p.y * 40 + p.x""", stored=True)

# The same scores with a band of faces that no view shows: holes many faces deep.
bind("holed_scores", """
SELECT scene_id, fid, view_id, CASE WHEN floor(fid / 20) % 30 BETWEEN 6 AND 27 THEN 0e0 ELSE score END AS score, r, g, b FROM face_scores""")

# Scores of well lit faces: every pair of views shares hundreds of them.
bind("lit_scores", """
SELECT scene_id, fid, view_id, score / 2 + 3e-1 AS score, r / 2 + 64 AS r, g / 2 + 64 AS g, b / 2 + 64 AS b FROM face_scores""")

# Which corners of which view carry depth support.
bind("vertex_support", """
SELECT v.scene_id, v.vid, p.view_id, p.r / 250e0 AS score, p.r, p.g, p.b
FROM vertices v JOIN pixels p ON v.scene_id * 1200 + v.vid = p.scene_id * 1200 + p.y * 40 + p.x
WHERE p.depth > 396e-2""", stored=True)

# UV atlas of 256 x 64 texels per scene.
bind("uv_corners", """
SELECT scene_id, fid, v0, v1, v2, completion,
  (x0 * 25e0 + 245e-1) / 49e0 AS ua, (y0 * 8e0 + 5e0) / 10e0 AS va, (x1 * 25e0 + 245e-1) / 49e0 AS ub,
  (y1 * 8e0 + 5e0) / 10e0 AS vb, (x2 * 25e0 + 245e-1) / 49e0 AS uc, (y2 * 8e0 + 5e0) / 10e0 AS vc FROM corners""")

# Points for votes: one per order line.
bind("points", """
SELECT CAST(floor(l_suppkey / 10) AS BIGINT) AS scene_id, CAST(l_suppkey % 5 AS INT) AS view_id,
  l_orderkey * 10 + l_linenumber AS point_id, (l_quantity - 255e-1) / 25e0 AS x,
  (round(l_discount * 100) - 5e0) / 8e0 AS y, (round(l_extendedprice * 100) / 1e7 - 5e-1) / 713e-2 AS z,
  CAST(l_quantity AS INT) * 5 AS r
FROM lineitem""")

# Silhouettes with large empty areas: the masked pixels of a disc that moves with the view.
bind("silhouettes", """
SELECT scene_id, view_id, x, y FROM pixels
WHERE mask AND (x - 6 - 5 * view_id) * (x - 6 - 5 * view_id) + (y - 12) * (y - 12) < 64""")

# Matches between neighbouring views, and review boxes.
bind("matches", """
SELECT a.scene_id, a.view_id AS view_a, b.view_id AS view_b, CAST(a.y * 40 + a.x AS BIGINT) AS match_id,
  CAST(a.x AS DOUBLE) AS xa, CAST(a.y AS DOUBLE) AS ya, a.x + (b.r - a.r) / 1e2 AS xb, a.y + (b.g - a.g) / 1e2 AS yb
FROM pixels a JOIN pixels b ON ((a.scene_id * 5 + (a.view_id + 1) % 5) * 30 + a.y) * 40 + a.x = ((b.scene_id * 5 + b.view_id) * 30 + b.y) * 40 + b.x
WHERE a.mask AND b.mask""", stored=True)

bind("regions", """
SELECT c.scene_id, n.n_nationkey AS region_id, c.view_id, CAST(n.n_nationkey AS INT) AS x0, CAST(n.n_regionkey * 4 AS INT) AS y0,
  CAST(n.n_nationkey + 12 AS INT) AS x1, CAST(n.n_regionkey * 4 + 12 AS INT) AS y1
FROM nation n JOIN cameras c ON n.n_regionkey = c.view_id""")

# Job events and resource samples.
bind("job_events", """
SELECT CAST(user_id AS STRING) AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'stage-started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'stage-reused'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS event,
  CASE event_id % 8 WHEN 0 THEN 'prepare' WHEN 1 THEN 'inference' WHEN 2 THEN 'fusion' WHEN 3 THEN 'unwrap'
    WHEN 4 THEN 'atlas' WHEN 5 THEN 'texture' WHEN 6 THEN 'package' ELSE NULL END AS stage,
  CAST(floor(value) % 5 AS INT) AS completed, CASE WHEN event_id % 3 = 0 THEN CAST(5 AS INT) ELSE NULL END AS total,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'Stage exceeded the task memory budget'
    WHEN event_type = 'error' THEN 'Invalid camera matrix' ELSE NULL END AS message, value
FROM events""")

bind("job_samples", """
SELECT CAST(user_id AS STRING) AS job_id, event_id, ts,
  CASE event_id % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'fusion' ELSE 'texture' END AS stage,
  value AS seconds, CAST(floor(value * 1e7) AS BIGINT) AS rss_bytes,
  CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 2e7) AS BIGINT) ELSE NULL END AS driver_bytes FROM events""")

bind("checkpoints", """
SELECT CAST(o_custkey AS BIGINT) AS job_id, CAST(o_orderkey % 7 AS INT) AS stage_order, min(o_orderkey) AS command_id,
  min(o_totalprice) > 100000 AS valid FROM orders GROUP BY 1, 2""")

bind("runs", """
SELECT o_custkey AS project_id, o_orderkey AS run_id, o_orderdate AS created_at,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'medium' ELSE 'reduced' END AS quality, o_totalprice > 150000 AS object_masking
FROM orders""")

# Two vector sets.
bind("vectors", """
SELECT lpad(CAST(vec_id AS STRING), 9, '0') AS vec_key, vec_id, label, embedding AS v FROM embeddings""")

# Poses that the engine reports for the photos; a photo it never mapped has no value.
bind("poses", """
SELECT photo_id, photo_id % 50 AS sample_id, CASE WHEN photo_id % 6 <> 0 THEN orientation > 3 ELSE NULL END AS located FROM photos""")
bind("sample_issues", "SELECT user_id % 60 AS sample_id, event_type AS issue, event_id AS seq FROM events")
