"""Small tables and plain-Python rules that the tests hold the operators against."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
                       T.StructField("block", T.StringType()), T.StructField("size", T.StringType())])


def documents(spark, texts, parts=3):
    """Rows (doc_id, text) or texts numbered from 0, with extra columns whose names clash with the operators' own."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}", None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.repartition(parts) if rows else frame


def words(text):
    return [w.decode() for w in (text or "").encode().split()]
