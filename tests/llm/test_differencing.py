import zlib
from collections import Counter, defaultdict

import numpy as np
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from surfex.llm.differencing import difference, shard_documents


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(1, 6))
def test_sums_follow_the_slot_maps(sizes, shards):
    partials = np.zeros((len(sizes), shards), np.int64)
    partials[:, 0] = sizes
    total, place = difference(partials)
    sums = np.zeros(shards, np.int64)
    for row, to in zip(partials, place):
        assert sorted(to) == list(range(shards))
        sums[to] += row
    assert sums.tolist() == total.tolist()


def test_differencing_example():
    partials = np.zeros((5, 2), np.int64)
    partials[:, 0] = [8, 7, 6, 5, 4]
    assert sorted(difference(partials)[0]) == [14, 16]


def check(rows, texts, shards):
    sums, slots, of = Counter(), defaultdict(list), {}
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
        assert of.setdefault(t, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sums


def test_whole_tables_over_several_levels(spark):
    rng = np.random.default_rng(3)
    texts = ["é" * int(n) for n in rng.integers(1, 400, 900)] + [None, "", "hot"] + ["hot"] * 60
    # Blocks of eight groups can't be even over five shards; the levels above make up for most of it.
    for bounds, most in (({"block_groups": 8, "fan_in": 4}, 4000), ({"block_groups": 100, "fan_in": 4}, 100), ({}, 20)):
        rows = shard_documents(documents(spark, texts), shards=5, **bounds).collect()
        assert len(rows) == len(texts)
        sums = check(rows, texts, 5)
        assert max(sums.values()) - min(sums.values()) <= most


def test_odd_rows(spark):
    rows = shard_documents(documents(spark, [(1, "a"), (1, "a"), (None, "a"), (None, None), (2, "z" * 200_000)]), shards=40).collect()
    assert len(rows) == 5 and len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"a")}) == 1
    assert sorted(r.slot for r in rows if r.text_crc32 == zlib.crc32(b"a")) == [0, 1, 2]
    assert shard_documents(documents(spark, []), shards=3).count() == 0
