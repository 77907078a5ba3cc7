import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from surfex.llm.four_russians import mine, pack_planes, quantise, scores, subset_sums

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("vector", T.StringType()), T.StructField("row", T.StringType()), T.StructField("line", T.StringType())])
WHOLE = st.integers(-2**40, 2**40)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(WHOLE, min_size=16, max_size=16), min_size=1, max_size=6), st.lists(st.lists(WHOLE, min_size=16, max_size=16), min_size=1, max_size=6))
def test_scores_are_inner_products(anchors, candidates):
    a, c = np.array(anchors, np.int64), np.array(candidates, np.int64)
    with np.errstate(over="ignore"):
        assert scores(subset_sums(a), pack_planes(c)).tolist() == (c @ a.T).tolist()


def test_small_values_take_few_planes():
    assert pack_planes(np.zeros((3, 8), np.int64)).shape == (1, 1, 3)
    assert len(pack_planes(np.array([[-1] + [0] * 7]))) == 1 and len(pack_planes(np.array([[255, -256] + [0] * 6]))) == 9
    extreme = np.array([[-2**63, 2**63 - 1] + [0] * 6])
    with np.errstate(over="ignore"):
        assert scores(subset_sums(extreme), pack_planes(extreme)).tolist() == (extreme @ extreme.T).tolist()


def whole(x):
    return math.floor(256 * float(x))


def expect(rows, every=100, few=5, factor=whole):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [factor(np.float32(x)) for x in v])
            good[i] = min(good.get(i, row), row)
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))
    out = []
    for i, (label, v) in good.items():
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, m) for j, (m, w) in good.items() if j != i)
        for s, j, m in [r for r in ranked if r[2] == label][:few]:
            near = [r for r in ranked if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:few]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(near)]
    return sorted(out)


def table(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, "x", "y", "z") for i, v, label in rows], SCHEMA)
    return frame.repartition(parts) if rows else frame


def vectors(n, dims, labels, seed):
    r = random.Random(seed)
    centre = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        m = r.randrange(labels)
        out.append((i, [c + r.gauss(0, 0.2) for c in centre[r.choice([m, m, 0])]], m))
    return out


@pytest.mark.parametrize("dims", [1, 8, 13, 64])
def test_whole_result(spark, dims):
    rows = vectors(700, dims, 3, dims)
    got = sorted(map(tuple, mine(quantise(table(spark, rows)), block_rows=50, anchor_rows=3, cell_pieces=2).collect()))
    assert got == expect(rows) and (dims == 1 or len(got) > 20)
    assert sorted(map(tuple, mine(quantise(table(spark, rows))).collect())) == got


def test_odd_rows_ties_and_repeats(spark):
    rows = [(i % 260, [0.5, -0.25] if i % 2 else [0.5, -0.25, 0.125], i % 3) for i in range(400)]
    rows += [(None, [1.0], 1), (300, None, 1), (400, [1.0, None], 1), (500, [float("nan")], 1), (600, [float("inf")], 1), (700, [1.0, 1.0], None),
             (800, [], 1), (900, [3e30, -3e30], 2), (900, [3e30, -3e30], 2), (1000, [-1.0, -1.0], 2), (-100, [0.5, 0.5], 0)]
    plain = [r for r in rows if r[0] is None or r[0] != 900]
    got = sorted(map(tuple, mine(quantise(table(spark, plain)), block_rows=7, anchor_rows=2).collect()))
    assert got == expect(plain) and {r[0] for r in got} >= {0, 100, 200}
    assert mine(quantise(table(spark, rows))).count() > 0


def test_hot_label_and_equal_vectors(spark):
    rows = [(i, [0.5] * 8, 1 if i % 3 else 2 + i % 5) for i in range(900)]
    assert sorted(map(tuple, mine(quantise(table(spark, rows)), block_rows=64, anchor_rows=2).collect())) == expect(rows)


def test_no_anchor_no_rows(spark):
    assert mine(quantise(table(spark, []))).collect() == []
    assert mine(quantise(table(spark, [(7, [1.0], 1), (8, [1.0], 1)]))).collect() == []
    assert mine(quantise(table(spark, [(100, [1.0], 1), (8, [1.0], 2)]))).collect() == []
