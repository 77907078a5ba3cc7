import re
import zlib
from collections import Counter

import pytest
from helpers import documents
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from surfex.llm import q_chunks
from surfex.llm.q_chunks import _parts, count_words, follow, group_variants, near_pairs


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, length, least, modulus):
    held = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % modulus == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= length:
                held[word] += 1
    return {w: n for w, n in held.items() if n >= least}


def grouped(words, ratio=5):
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()), key=lambda r: r[0])


TEXTS = ["Running RUNNING runing, running running-running " * 4, "Größe größe GRÖßE Grösse größen größem " * 3, None, "", "nolettershere" * 20_000 + " running", "running " * 50_000,
         "Ärger ärger Ärgern ÄRGERN àrgern×÷ ", "colour color colours colors colouur " * 9, "x1y2 running_running\nrunning's"] + ["hot words everywhere hotwords " * 30] * 20


@pytest.mark.parametrize("modulus", [199, 2])
def test_words(spark, modulus):
    rows = [*enumerate(TEXTS), (3, "running"), (3, "running"), (None, "running " * 7)]
    got = {r.word: r.n for r in count_words(documents(spark, rows, 4), 6, 5, modulus).collect()}
    assert got == counted(rows, 6, 5, modulus) and len(got) > 3


@settings(deadline=None, max_examples=60)
@given(st.text("abé ", max_size=60), st.integers(1, 9))
def test_parts_keep_runs(text, size):
    held, q_chunks._PART = q_chunks._PART, size
    try:
        parts = list(_parts(text))
    finally:
        q_chunks._PART = held
    assert "".join(parts) == text
    assert [r for p in parts for r in re.findall("[a-zÀ-ÿ]+", p)] == re.findall("[a-zÀ-ÿ]+", text)


@settings(deadline=None, max_examples=15, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("abé", min_size=2, max_size=7), min_size=1, max_size=60))
def test_pairs(spark, words):
    got = near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).collect()
    expect = sorted(tuple(sorted((v, w))) for v in words for w in words if v < w and one_edit(v, w))
    assert sorted(tuple(sorted((r.a, r.b))) for r in got) == expect


def test_whole_result(spark):
    words = counted(list(enumerate(TEXTS)), 6, 1, 3)
    frame = group_variants(count_words(documents(spark, TEXTS, 5), 6, 1, 3))
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(frame) == grouped(words) and any(r[1] for r in grouped(words))


def test_forms_ties_and_crowded_chunks(spark):
    words = {"common" + a + b: 1 + (ord(a) * ord(b)) % 97 for a in "abcdefghijkl" for b in "abcdefghijklmnop"} | {"commona": 500, "common": 3000, "zzzzzza": 40, "zzzzzzb": 40, "zzzzzz": 8}
    got = rows_of(group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words)
    assert {r[2] for r in got if r[0].startswith("commona")} == {"common"} and next(r for r in got if r[0] == "zzzzzz")[1] == "zzzzzza"


def test_long_chain_and_empty_table(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)], "word string, form string")
    assert {r.root for r in follow(chain).collect()} == {"w21"}
    assert group_variants(count_words(documents(spark, []))).collect() == []
    assert group_variants(count_words(documents(spark, [None, "", "short"]))).collect() == []
