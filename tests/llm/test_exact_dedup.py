import hashlib

import numpy as np
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from surfex.llm.exact_dedup import drop_copies, find_copies, rice_decode, rice_encode


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=50))
def test_code_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    base, k, unary, rest = rice_encode(values)
    assert rice_decode(len(values), base, k, unary, rest).tolist() == values.tolist()


TEXTS = ["a", "b", "a", None, "", "a ", "A", "x" * 300_000, "x" * 300_000, "c", "a"] + ["hot"] * 40


def expect(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        out.append((i, max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def test_whole_result(spark):
    rows = list(enumerate(TEXTS))
    got = find_copies(documents(spark, TEXTS, 5), block_rows=4).drop("fp").collect()
    assert sorted(map(tuple, got)) == expect(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "t"), (5, "t"), (5, "other"), (None, "t"), (None, "alone"), (7, "u"), (7, "u"), (7, "u")]
    got = find_copies(documents(spark, rows, 4)).collect()
    assert len(got) == 8
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id) == [(5, 5, 1), (5, 5, 3), (5, 5, 3), (7, 7, 3), (7, 7, 3), (7, 7, 3)]
    assert sum(r.kept for r in got) == 4
    left = drop_copies(documents(spark, rows, 4))
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "alone"), (5, "other"), (5, "t"), (7, "u")]
    assert left.columns == documents(spark, rows).columns
    assert find_copies(documents(spark, [])).count() == 0
