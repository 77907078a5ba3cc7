import random
import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surfex.llm import partenum_join
from surfex.llm.common import components
from surfex.llm.partenum_join import bands, connect, keep_one, shingle_sets, signatures, similar_groups


def shingles(text, n=3):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, n=3, percent=90):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)] if s else i) for x, (i, s) in enumerate(sets))


@settings(deadline=None, max_examples=400)
@given(st.integers(1, 60), st.integers(0, 14), st.integers(0, 14), st.sampled_from((90, 80)), st.integers(0, 99))
def test_similar_sets_share_a_signature(shared, more, other, percent, seed):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 2**63, shared + more + other, dtype=np.uint64)
    a, b = h[:shared + more], np.concatenate([h[:shared], h[shared + more:]])
    if more + other and 100 * shared >= percent * len(h):
        at, sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[at == 0]) & set(sig[at == 1])


def test_bands_cover_all_sizes():
    for percent in (80, 90):
        table = bands(percent, 5000)
        assert [low for low, _, _ in table[1:]] == [high + 1 for _, high, _ in table[:-1]]


def test_short_texts_and_case():
    doc, h = shingle_sets([b"A b", b"a B", b"", b"a b c", b"a", b"b c d b c d"], 3)
    assert np.bincount(doc, minlength=6).tolist() == [1, 1, 0, 1, 1, 3] and h[0] == h[1] and len(set(h.tolist())) == 6


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (3, 5), (9, 9), (200, 5)] + [(1000, 1000 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 3, 3: 3, 5: 3, 200: 3} | {1000 + i: 1000 for i in range(60)}


def copies(seed, size=60, length=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9999)}" for _ in range(length)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_groups_against_all_pairs(spark):
    texts = copies(1) + copies(2, 40, 25) + copies(3, 30, 200) + [None, "", " ", "a", "A", "a b", "a b c", "A B c", "long " * 50_000] + ["same text over and over again"] * 30
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    docs = documents(spark, texts, 4)
    got = similar_groups(docs, block_rows=10, crowd=3).collect()  # small blocks, so that crowds settle in several
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(rows)
    assert sum(r["first"] for r in got) == len({r.component_id for r in got})
    blocks = similar_groups(docs, crowd=3, block_classes=6)  # small blocks of classes, so that pairs of blocks are needed
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in blocks.collect()) == groups(rows)
    kept = keep_one(docs)  # five words, 0.8
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups(rows, 5, 80)}) and kept.columns == docs.columns


def test_real_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = similar_groups(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups([(r.doc_id, r.text) for r in docs.collect()])


def test_edges_connect_as_links_do():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 2**62, rng.integers(0, 5))])) for _ in range(40)]
    sets += [rng.integers(0, 2**62, 5000), np.zeros(0, np.int64)]
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    allowed = rng.random((42, 42)) < 0.5
    allowed &= allowed.T
    np.fill_diagonal(allowed, False)

    def joined(pairs):
        root = list(range(42))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return [root.index(r) for r in root]

    links = [(a, b) for a in range(42) for b in range(a) if allowed[a, b] and len(sets[a]) and len(sets[b])
             and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
    got = connect(np.concatenate(sets), cuts, allowed, 85)
    assert 0 < len(got) < len(links) and joined(got) == joined(links)


def test_a_group_that_is_close_but_not_linked(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(80)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.05 else w for w in base) for _ in range(150)]
    got = similar_groups(documents(spark, texts, 3), block_classes=16).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(list(enumerate(texts)))


def test_columns_with_own_names(spark):
    docs = documents(spark, copies(6, 12, 90) + [None])
    for name in ("_gone_id", "gone_id", "gone_fp", "_fp", "fp", "id", "row", "node", "leader"):
        docs = docs.withColumn(name, F.lit(name))
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("fp != 'fp' OR id != 'id' OR gone_id != 'gone_id'").isEmpty() and 1 < kept.count() < 13


def test_odd_rows(spark):
    rows = similar_groups(documents(spark, [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (4, "other words here now"), (None, None), (9, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows) == [(0, 0, 0), (0, 2, 4), (4, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9)]
    assert similar_groups(documents(spark, [])).count() == 0


def test_a_block_is_signed_in_little_memory(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 1)

    rng = np.random.default_rng(11)
    texts = [" ".join(map(str, rng.integers(0, 99_999, 500))) for _ in range(2000)]  # 6 MB, one block
    table = pa.table({"doc_id": range(2000), "text": texts, "fp": range(2000)}).combine_chunks()
    monkeypatch.setattr(partenum_join, "TaskContext", Task)
    tracemalloc.start()
    rows = sum(b.num_rows for b in partenum_join._scan(5, 80, "signatures", 20_000, 64)(iter(table.to_batches())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 500_000 and peak < 90e6


def test_runs_of_sets_have_the_signatures_of_each_set_alone(monkeypatch):
    rng = np.random.default_rng(12)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 0, 5, 700, 40, 1200, 1)]
    cuts = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    monkeypatch.setattr(partenum_join, "_RUN", 600)
    at, found = signatures(np.concatenate(sets), cuts, 80)
    for i, x in enumerate(sets):
        assert sorted(found[at == i]) == sorted(signatures(x, np.array([0, len(x)]), 80)[1])
    assert found.max() < 1 << 48
