"""Queries of the training-data operators over the whole test tables, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, differencing, exact_dedup, four_russians, license_rules, line_hash, partenum_join, phrase_automata, prefix_bpe, q_chunks, quality_trees, robust_rules, secret_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(table) -> DataFrame``; ``table`` reads one of the given tables by name."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_golomb_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def _(table):
    return exact_dedup.find_copies(table("documents")).drop("fp")


@query("op2_tree_quality")
def _(table):
    return quality_trees.classify(table("documents"), table("labels"))


@query("op4_differencing_shards")
def _(table):
    return differencing.shard_documents(table("documents")).drop("group_key")


@query("op6_prefix_bpe")
def _(table, path=public_tokenizers.path("word_bpe_49k.json")):
    docs = table("documents").select("doc_id", "text")
    done = prefix_bpe.decode(prefix_bpe.encode(docs, path), path)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_randomness_secrets")
def _(table):
    found = secret_scan.find_secrets(table("documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["place"] < 3)
    count = lambda place: F.size(F.filter("spans", lambda s: s["place"] == place)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


@query("op9_variable_best_fit")
def _(table):
    return best_fit.pack(table("documents"))


def _license_oracle() -> str:
    """The same cut, map and ordered rules as list functions; a rule is met if each of its sentences follows the one before."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = "map([" + ", ".join(map(quoted, license_rules.SENTENCES.values())) + "], [" + ", ".join(map(quoted, license_rules.SENTENCES)) + "])"
    longer = {(n, r): [q for m, q in license_rules.RULES if m != n and len(q) > len(r) and q[:len(r)] == r] for n, r in license_rules.RULES}
    met = lambda r: "regexp_matches(joined, " + quoted(".*".join(f",{s}," for s in r)) + ")"
    cases = ", ".join(f"CASE WHEN {met(r)}" + "".join(f" AND NOT {met(q)}" for q in longer[n, r]) + f" THEN {quoted(n)} END" for n, r in license_rules.RULES)
    return rf"""
WITH pieces AS (SELECT doc_id, row_number() OVER () AS id, string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    '([.!?:;])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\n[ \t\n\x0b\f\r]*\n', chr(1), 'g'), '\n([ \t]*([0-9]+\.|[*-]) |[A-Z][a-z])', chr(1) || '\1', 'g'), chr(1)) AS parts
  FROM documents),
plain AS (SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[ \t\n\x0b\f\r]*([0-9]+\.|[*-])[ \t\n\x0b\f\r]', ''), '[^a-z0-9]+', ' ', 'g'))) AS parts FROM pieces),
known AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: {names}[s]), lambda x: x IS NOT NULL) AS ids FROM plain),
text AS (SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: ',' || x || ','), 'string_agg', '') AS joined FROM known)
SELECT doc_id, len(ids) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids,
  coalesce(list_aggregate(list_sort(list_distinct([{cases}])), 'string_agg', ','), '') AS licences FROM text"""


@query("op8_license_rules", _license_oracle())
def _(table):
    found = license_rules.recognise(table("documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"))


@query("op7_robust_outliers")
def _(table):
    return robust_rules.apply_rules(table("documents"))


@query("op5_partenum_join")
def _(table):
    return partenum_join.similar_groups(table("documents")).drop("first", "fp")


@query("op3_phrase_automata")
def _(table):
    return phrase_automata.remove_repeats(table("documents"))


@query("op12_line_hash", r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  cut AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
  keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
  often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY r""")
def _(table):
    done = line_hash.dedup_lines(table("documents"), min_documents=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_four_russians", """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.vector, c.vector)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
  positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER pair)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW pair AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER pair <= 5""")
def _(table):
    rows = four_russians.quantise(table("embeddings"), 256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return four_russians.mine(rows.withColumn("label", moved), every=100, positives=5, negatives=5, low=80, high=100)


@query("op11_q_chunks")
def _(table):
    return q_chunks.group_variants(q_chunks.count_words(table("documents"), min_length=6, min_count=5, modulus=199), ratio=5)
