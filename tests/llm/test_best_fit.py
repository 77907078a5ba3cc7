from collections import defaultdict

import numpy as np
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from surfex.llm.best_fit import LENGTHS, pack, pack_block, sequence_cost


def plain(sizes, lengths):
    """The same rule over a list of open bins, looked through for every piece."""
    bins, out = [], []
    left = sum(sizes)
    for size in sizes:
        open_ = [b for b in bins if b["free"] >= size]
        if open_:
            least = min(b["free"] for b in open_)
            b = max((b for b in open_ if b["free"] == least), key=lambda b: b["touched"])
        else:
            length = min((c for c in lengths if c >= size), key=lambda c: (sequence_cost(c) / min(c, left), -c))
            b = {"id": len(bins), "free": length, "used": 0}
            bins.append(b)
        out.append((b["id"], b["used"]))
        b["used"] += size
        b["free"] -= size
        b["touched"] = len(out)
        left -= size
    return [(k, at, min(c for c in lengths if c >= bins[k]["used"])) for k, at in out]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_block_against_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    assert list(zip(*(x.tolist() for x in pack_block(np.array(sizes, int), (8, 16, 64))))) == plain(sizes, (8, 16, 64))


def check(rows, sizes):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.piece_start, r.piece_size))
        if r.piece_size:
            bins[r.bin_id].append((r.bin_offset, r.piece_size, r.bin_length))
        else:
            assert r.bin_id is None
    for i, size in sizes.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(docs[i])):
            assert (piece, start) == (k, at) and n <= LENGTHS[-1]
            at += n
        assert at == size
    for pieces in bins.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert {p[2] for p in pieces} == {min(c for c in LENGTHS if c >= at)}
    return sum(p[0][2] for p in bins.values())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    room = check(pack(docs).collect(), sizes)
    assert sum(sizes.values()) / room > 0.97
    check(pack(docs, block_pieces=50).collect(), sizes)


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "w " * 20_000, "one", "one"]
    check(pack(documents(spark, texts)).collect(), {i: len(words(t)) for i, t in enumerate(texts)})
    assert pack(documents(spark, [(None, "a"), (2, "a b"), (2, "a b")])).count() == 3
    assert pack(documents(spark, [])).count() == 0
