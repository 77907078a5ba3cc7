import json
from collections import Counter

import numpy as np
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from surfex.llm.robust_rules import FLOORS, apply_rules, chi_limit, consistency, count_text


def counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text("ab é\n#|\t ", max_size=120), max_size=6))
def test_counts(texts):
    assert count_text([t.encode() for t in texts]).tolist() == [counts(t) for t in texts]


def test_long_text_over_several_pieces():
    text = ("one two three four five six seven eight nine\n" * 60_000) + "x" * 3_000_000
    assert count_text([text.encode(), b"a"]).tolist() == [counts(text), counts("a")]


def concentration(x, share=0.75, steps=4):
    """Concentration steps on one group with every row in memory and whole rows instead of distance bins."""
    mean = np.median(x, 0)
    cov = np.diag((1.4826 * np.median(np.abs(x - mean), 0)) ** 2 + np.square(FLOORS))
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = x[np.argsort(d, kind="stable")[:int(round(share * len(x)))]]
        mean, cov = near.mean(0), consistency(share) * np.cov(near.T, bias=True) + np.diag(np.square(FLOORS))
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def test_whole_table_against_in_memory_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows = apply_rules(docs).collect()
    assert len(rows) == len(texts)
    groups = {}
    for r in rows:
        own = counts(texts[r.doc_id].text)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        if not r.base_failed:
            groups.setdefault((texts[r.doc_id].lang, texts[r.doc_id].source), []).append(r)
        else:
            assert not r.kept
    limit, judged, agree = chi_limit(1e-6), 0, 0
    for own in groups.values():
        if len(own) >= 60:
            x = np.array([[np.log(r.word_chars / r.n_words), *(np.log1p(100 * c / r.n_words) for c in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))] for r in own])
            judged += len(own)
            agree += sum((d <= limit) == r.kept for d, r in zip(concentration(x), own))
    assert judged > 3000 and agree / judged > 0.998


def test_clean_rows_stay_and_symbol_rows_go(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in apply_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect() if not r.base_failed and r.doc_id in labels]
    clean = [r.kept for r in rows if labels[r.doc_id] == 1]
    noisy = [r.kept for r in rows if labels[r.doc_id] == 0 and r.n_symbols > r.n_words]
    assert np.mean(clean) > 0.995 and len(noisy) > 20 and np.mean(noisy) < 0.1, json.dumps([np.mean(clean), np.mean(noisy)])


def test_odd_rows(spark):
    rows = apply_rules(documents(spark, [None, "", (None, "a " * 10), (4, "b " * 400), (4, "b " * 400), "e f g h"] + [" ".join(f"w{i}{j}" for j in range(30)) for i in range(5)])).collect()
    assert len(rows) == 11 and sum(r.kept for r in rows) == 5
    assert apply_rules(documents(spark, [])).count() == 0


def test_each_statistic_alone_rejects(spark):
    def prose(name, n=400, size=5):
        return [f"{name}{k:03d}".ljust(size - 2 + k % 5, "q")[:size + 2] + f"{k:03d}"[k % 2:] for k in range(n)]

    def lines(w, at=0, width=10):
        return "\n".join([" ".join(w[:at])] * (at > 0) + [" ".join(w[i:i + width]) for i in range(at, len(w), width)])

    plain = [lines(prose(f"{chr(97 + i // 10)}{i % 10}")) for i in range(90)]
    long = lines([w * 2 for w in prose("zl")])
    symbols = lines([w + "#" * (k % 10 == 0) for k, w in enumerate(prose("zs"))])
    w = prose("zr", 280)
    repeated_lines = "\n".join(f"{' '.join(w[i:i + 7])}\nthese three words" for i in range(0, 280, 7))
    w = prose("zw", 350)
    repeated_words = lines(w[:200]) + "\n" + lines(w[50:100] + w[200:], at=3)
    rows = sorted(apply_rules(documents(spark, [*plain, long, symbols, repeated_lines, repeated_words])).collect(), key=lambda r: r.doc_id)
    assert all(r.kept for r in rows[:90]) and not any(r.base_failed for r in rows)
    ratio = np.array([[r.word_chars / r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in rows])
    assert (ratio[90:, 1:] > 0).tolist() == [[False] * 3, [True, False, False], [False, True, False], [False, False, True]]
    assert [r.kept for r in rows[90:]] == [False] * 4
