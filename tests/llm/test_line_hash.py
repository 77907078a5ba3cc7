from collections import Counter

import numpy as np
import pytest
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from surfex.llm import line_hash
from surfex.llm.line_hash import PerfectHash, build_index, cut_lines, dedup_lines, drop_lines, probe_index


@settings(deadline=None, max_examples=60)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=300))
def test_every_key_has_a_slot_of_its_own(keys):
    keys = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    index = PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    again = PerfectHash(index.levels, index.bits)
    assert again.slots(keys).tolist() == index.slots(keys).tolist()


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def expect(rows, least, chars=1):
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [(0, None), (1, ""), (2, "\n\n"), (3, "Über uns\nüber uns"), (4, "hot\nalone"), (5, " HOT\t\n\x0bhot\r\ntail"), (6, "hot"), (6, "hot"), (None, "hot\nx"), (None, None),
        (7, " hot "), (8, "a\n" * 3000 + "hot"), (9, "b\nb\nb"), (10, "b\nc"), (11, "C \n\x0c"), (12, "y" * 200_000 + "\nhot"), (13, "ß\nß"), (14, "ÜBER UNS")]


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_whole_result(spark, least):
    assert got(dedup_lines(documents(spark, ROWS, 4), least, max_bytes=64)) == expect(ROWS, least)
    assert got(dedup_lines(documents(spark, ROWS, 4), least)) == expect(ROWS, least)


def test_least_length_in_code_points(spark):
    assert got(dedup_lines(documents(spark, ROWS, 2), 2, min_chars=3)) == expect(ROWS, 2, 3)
    with pytest.raises(ValueError):
        dedup_lines(documents(spark, ROWS), 2, min_chars=0)


def test_hot_line_in_a_third_of_all_rows(spark):
    rows = [(i, f"common\nown {i}\npair {i // 2}" if i % 3 == 0 else f"own {i}\npair {i // 2}") for i in range(3000)]
    assert got(dedup_lines(documents(spark, rows, 7), 10, max_bytes=500)) == expect(rows, 10)


def test_rows_keep_all_columns(spark):
    clash = documents(spark, ROWS, 3).withColumnsRenamed({"fp": "gone", "block": "row", "size": "text_key"}).selectExpr("*", "1 AS own", "2 AS kept")
    left = drop_lines(clash, 2)
    assert left.columns == clash.columns and left.schema == clash.schema
    kept = sorted((str(i), str(None if t is None else expect_one(t, 2))) for i, t in ROWS)
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == kept
    assert {(r.gone, r.row, r.own) for r in left.collect()} == {("x", "y", 1)}


def expect_one(text, least):
    held = Counter(k for _, t in ROWS for k in {key(x) for x in (t or "").split("\n")} if k)
    return "\n".join(x for x in text.split("\n") if not key(x) or held[key(x)] < least)


def test_index_of_earlier_documents(spark):
    index = build_index(cut_lines(documents(spark, [(i, f"menu\nold {i}") for i in range(6)], 2)))
    assert sum(r.n_lines for r in index.collect()) == 7
    new = documents(spark, [(i, f"new {i}\nMENU \nfresh") for i in range(9)], 2)
    marks = probe_index(cut_lines(new), index, 6).collect()
    assert len(marks) == 9 and {tuple(r.gone) for r in marks} == {(False, True, False)}
    assert {r.kept for r in dedup_lines(new, 6, index=index).collect()} == {f"new {i}\nfresh" for i in range(9)}


def test_empty_table(spark):
    assert dedup_lines(documents(spark, []), 2).collect() == []
    assert dedup_lines(documents(spark, [None, ""]), 1).count() == 2
    assert line_hash.build_index(cut_lines(documents(spark, [None]))).count() == 0
