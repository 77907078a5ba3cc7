import hashlib
import random

from helpers import documents, words

from surfex.llm.phrase_automata import compile_phrases, locate, remove_repeats


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept) by looking every window up among all earlier ones; rows have distinct ids."""
    first = {}
    ordered = sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0])
    out = []
    for i, text in ordered:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            if g in first:
                gone[s:s + window] = [True] * window
            else:
                first[g] = (i, s)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in frame.collect()), key=str)


def test_locate():
    automaton = compile_phrases([b"a b", b"b a", "é".encode()])
    assert sorted(locate(automaton, [b"a", b"b", b"a", b"ab", "é".encode(), b"a"]).tolist()) == [0, 1, 4]


def texts():
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [some(rng.choice((19, 20, 21, 35, 60))) for _ in range(8)]
    out = []
    for _ in range(120):
        t = some(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            at = rng.randrange(len(t) + 1)
            t[at:at] = p[a:] if rng.random() < 0.5 else p
        out.append((" " if rng.random() < 0.9 else "\n\t ").join(t))
    out += [out[3], out[3], out[5] + " \n", None, "", " \t", "x " * 19, "x " * 20, "x " * 21, "ab " * 50, "y " * 3000, "y " * 100, "Ä ö " * 15, "v" * 100_000]
    return out + ["one hot text " + " ".join(map(str, range(40)))] * 40


def test_whole_result_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = documents(spark, rows, 5)
    for options in ({}, {"block_bytes": 500, "piece_rows": 7}):
        assert got(remove_repeats(docs, with_text=True, **options)) == brute(rows)
    for r in remove_repeats(docs).collect():
        kept = next(b for b in brute(rows) if b[0] == r.doc_id)
        assert (r.n_removed, r.kept_sha256) == (kept[2], hashlib.sha256(kept[3].encode()).hexdigest())
    assert got(remove_repeats(docs, window=9, phrase=4, with_text=True)) == brute(rows, 9)


def test_real_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(remove_repeats(docs, with_text=True)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(map(str, range(30)))
    rows = [(None, long), (3, long), (3, long), (3, "z " + long), (4, long + " z"), (None, None)]
    result = remove_repeats(documents(spark, rows), with_text=True).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in result) == [(3, 30, 0), (3, 30, 0), (3, 31, 30), (4, 31, 30), (99, 0, 0), (99, 30, 30)]
    assert remove_repeats(documents(spark, [])).count() == 0
