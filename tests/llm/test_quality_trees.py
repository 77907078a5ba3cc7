import zlib

import numpy as np
from helpers import documents, words

from surfex.llm.quality_trees import STATISTICS, classify, fit, grow, held_out, keep_good, statistics


def walk(trees, row):
    """One row down every tree, a node at a time."""
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_flat_arrays_equal_a_walk_and_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = grow(x[:600], y[:600])
    got = trees.score(x)
    assert np.allclose(got, [walk(trees, r) for r in x])
    assert ((got[600:] >= 0.5) == y[600:]).mean() > 0.95


def test_statistics_by_hand():
    row = dict(zip(STATISTICS, statistics([b"", b"The cat! cat 12 | x\n\nThe cat! cat 12 | x", b" \n "])[1]))
    text = "The cat! cat 12 | x\n\nThe cat! cat 12 | x"
    w = words(text)
    assert row["log_words"] == np.log1p(len(w)) and row["distinct_words"] == len(set(w)) / len(w) and row["longest_word"] == 4
    assert row["repeated_lines"] == 0.5 and row["bars"] == 2 / 12 and row["exclamations"] == 2 / 12 and row["digits"] == 4 / sum(map(len, w))
    assert not statistics([b"", b" \n "]).any()


def test_accuracy_on_rows_never_learnt(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and len(got) == docs.count()
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (3, 0), (None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    docs = documents(spark, [None, "", "word " * 50_000, "!! !!", (None, "x"), (3, "!! !!"), (3, "!! !!")])
    got = classify(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None for r in got) == 1
    assert classify(documents(spark, []), labels).count() == 0
    assert keep_good(docs, labels.limit(0)).columns == docs.columns
    assert fit(docs, labels, max_rows=1).feature.shape[0] == 0
    assert docs.select(held_out()).count() == 7
