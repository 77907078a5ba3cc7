import zlib

import numpy as np
import pytest

import corpus_pipeline
from helpers import documents, words
from pyspark.sql import functions as F

from surfex.llm import exact_dedup, secret_scan
from surfex.llm.quality_trees import STATISTICS, fit, statistics
from surfex.session import cut_lineage
from test_best_fit import check
from test_partenum_join import groups
from test_secret_scan import brute


@pytest.fixture(scope="module")
def kept(spark):
    """The documents after each stage, as rows by doc_id."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], folder)))
    return out, folder


def rows(frame):
    return {r.doc_id: r.asDict() for r in frame.collect()}


def test_every_stage_against_plain_python(spark, kept):
    frames, folder = kept
    docs, good, single, group, clean, packed = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    before = rows(docs)
    model = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    x = statistics([(r["text"] or "").encode() for r in before.values()])
    accepted = {i for i, p in zip(before, model.score(x.reshape(-1, len(STATISTICS)))) if p >= 0.5}
    assert set(rows(good)) == accepted and rows(good) == {i: before[i] for i in accepted}
    last = {}
    for i in sorted(accepted):
        last[before[i]["text"]] = i
    assert set(rows(single)) == set(last.values())
    assert set(rows(group)) == {c for _, _, c in groups([(i, before[i]["text"]) for i in rows(single)], 5, 80)}
    left = rows(group)
    ids = list(left)
    spans = brute([left[i]["text"] for i in ids])
    done = rows(clean)
    assert set(done) == set(ids)
    for i, own in zip(ids, spans):
        text, at, new = left[i]["text"], 0, ""
        for a, _, b in own:
            new, at = (new + text[at:a] + "[secret]" if a >= at else new), max(at, b)
        assert done[i]["text"] == new + text[at:] and done[i]["n_chars"] == (len(done[i]["text"]) if own else left[i]["n_chars"])
    check(packed.collect(), {i: len(words(r["text"])) for i, r in done.items()})


def test_run_gives_the_last_stage(spark, kept):
    frames, folder = kept
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, frames[-1].collect()), key=str)


def test_clean_documents_stay(spark, kept):
    frames, folder = kept
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = set(rows(frames[1]))
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1 and labels[i] == 1]
    assert np.mean([i in good for i in held]) > 0.9


def test_stages_keep_columns_with_their_own_names(spark):
    docs = documents(spark, ["one text", "one text", "other text", None, "api_key=abcdef0123456789 here", "api_key=abcdef0123456789 here"])
    names = ("_text", "_base", "_tested", "_cleared", "cleared", "row", "spans", "gone_id", "_gone_id", "_fp", "fp", "id", "repeated")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    kept = exact_dedup.drop_copies(docs)
    cleared = secret_scan.redact(docs)
    for out, ids in ((kept, [1, 2, 3, 5]), (cleared, [0, 1, 2, 3, 4, 5])):
        assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)
        assert sorted(r.doc_id for r in out.collect()) == ids
    assert [(r.text, r.n_chars) for r in cleared.filter("doc_id = 4").collect()] == [("[secret] here", 13)]
