"""Substring dedup by repeated-phrase automata.

Every window of ``window`` consecutive words has one anchor, its ``phrase``-word run with the least hash, so equal windows
have equal anchors. One scan finds the anchors that recur; the windows around them are hashed, and those that recur are
confirmed. Documents are dealt into blocks of bounded size; for each block an Aho-Corasick automaton is compiled of the
anchor phrases confirmed in it, and its documents stream through it. Each located phrase gives the windows to look up, and
those that have an earlier occurrence cover the words to remove.

So every document passes one automaton, and an automaton holds only phrases of its own block: both grow with the input
and not with its square. Whatever a hot passage repeats, a block sends one row for it. A bit filter of fixed size keeps
documents without a recurring anchor out of the shuffles; when it is full it lets all pass, and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import in_pieces, long_array, mix, partitions, text_pieces, utf8, whole_text, word_grams, word_hashes

_LAST = (1 << 63) - 1


class _Windows:
    """Windows of the texts of one piece: text, first word, hash, anchor hash and anchor's first word."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, window: int, phrase: int):
        self.start, self.end, hashes = word_hashes(data)
        self.at = np.searchsorted(self.start, bounds)
        n = np.diff(self.at)
        whole = word_grams(hashes, window)
        owner = np.repeat(np.arange(len(n)), n)[:len(whole)]
        self.word = np.flatnonzero(np.arange(len(whole)) + window <= self.at[owner + 1])
        self.doc, self.hash = owner[self.word], whole[self.word]
        runs = np.lib.stride_tricks.sliding_window_view(word_grams(hashes, phrase), window - phrase + 1) if len(whole) else np.zeros((0, 1), np.uint64)
        least = np.concatenate([runs[k:k + 65_536].argmin(1) for k in range(0, len(runs), 65_536)] or [np.zeros(0, np.int64)])
        self.spot = (np.arange(len(runs)) + least)[self.word]
        self.anchor = runs[self.word, least[self.word]]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in in_pieces(batches, 4096, 2 << 20):
        counts, shas = [], []
        for text in utf8(table["text"].combine_chunks()):
            words = text.split()
            counts.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).digest())
        rows = table.select(["doc_id", "fp"]).append_column("n_words", pa.array(counts, pa.int64())).append_column("sha", pa.array(shas, pa.binary()))
        yield from rows.to_batches()


def _first(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _anchors(window: int, phrase: int, piece_rows: int):
    """Per piece each anchor with its least text, its largest if that is another, and 1 if a text has it twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_pieces(batches, piece_rows):
            own = long_array(table["tag"].combine_chunks())
            anchors, spots = [], []
            for first, _, data, bounds in text_pieces(utf8(table["text"].combine_chunks())):
                w = _Windows(data, bounds, window, phrase)
                keep = _first(w.spot)  # neighbours share an anchor; the places of anchors never step back
                anchors.append(w.anchor[keep])
                spots.append(first + w.doc[keep])
            a, d = np.concatenate(anchors), np.concatenate(spots)
            t = own[d]
            order = np.lexsort((d, t, a))
            a, t, d = a[order], t[order], d[order]
            heads = _first(a)
            tails = np.append(heads[1:], len(a)) - 1
            twice = np.zeros(len(a), np.int32)
            twice[1:] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
            low, high = t[heads], t[tails]
            yield pa.RecordBatch.from_arrays([pa.array(a[heads].view(np.int64)), pa.array(low), pa.array(high, mask=low == high),
                                              pa.array(np.maximum.reduceat(twice, heads) if len(a) else twice)], names=["anchor", "low", "high", "twice"])

    return run


def _places(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each anchor in a filter of ``2 ** bits`` bits."""
    return np.concatenate([mix(anchors ^ np.uint64(seed)) >> np.uint64(64 - bits) for seed in (11, 12)]).astype(np.int64)


def anchor_filter(recurring: DataFrame, bits: int = 27, slice_bits: int = 19) -> np.ndarray:
    """Bits of all recurring anchors, set slice by slice on the executors; 2 ** bits / 8 bytes reach the driver, however many there are."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(long_array(batch["anchor"]).view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> slice_bits), pa.array((at & ((1 << slice_bits) - 1)).astype(np.int32))], names=["slice", "bit"])

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.zeros(1 << slice_bits, np.uint8)
        own[rows["bit"].to_numpy()] = 1
        return pa.table({"slice": [key[0].as_py()], "bits": [np.packbits(own).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8).reshape(-1, 1 << (slice_bits - 3))
    for row in recurring.mapInArrow(spread, "slice long, bit int").distinct().groupBy("slice").applyInArrow(fill, "slice long, bits binary").collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _likely(window: int, phrase: int, sent, bits: int):
    """Texts that hold an anchor of the filter, with those anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_pieces(batches, 4096):
            texts, kept, lists = utf8(table["text"].combine_chunks()), [], []
            for first, last, data, bounds in text_pieces(texts):
                w = _Windows(data, bounds, window, phrase)
                keep = _first(w.spot)
                anchors, doc = w.anchor[keep], w.doc[keep]
                at = _places(anchors, bits).reshape(2, -1)
                hit = ((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)
                anchors, doc = anchors[hit].view(np.int64), doc[hit]
                cuts = np.searchsorted(doc, np.arange(last - first + 1))
                for i in np.unique(doc).tolist():
                    kept.append(first + i)
                    lists.append(np.unique(anchors[cuts[i]:cuts[i + 1]]))
            rows = table.select(["block", "doc", "fp", "text"]).take(pa.array(kept, pa.int64()))
            yield from rows.append_column("anchors", pa.array(lists, pa.list_(pa.int64()))).to_batches()

    return run


_FOUND = pa.schema([("block", pa.int64()), ("anchor", pa.int64()), ("window", pa.int64()), ("short", pa.int32()), ("doc", pa.int64()), ("times", pa.int32()),
                    ("phrase", pa.binary())])
_FOUND_DDL = "block long, anchor long, window long, short int, doc long, times int, phrase binary"


def _rows(block: int, n: int, **columns) -> pa.Table:
    return pa.Table.from_arrays([pa.array(np.full(n, block)), *(columns.get(f.name, pa.nulls(n, f.type)) for f in list(_FOUND)[1:])], schema=_FOUND)


def _short(anchors: np.ndarray) -> np.ndarray:
    """32 bits of the anchors' hashes, which windows are told apart by beside their own 64."""
    return (anchors >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _texts(held: pa.Table, skipped: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts of a block in order of id, without whole repeats: texts, ids and fingerprints."""
    held = held.sort_by([("doc", "ascending"), ("fp", "ascending")])
    ids, fps = long_array(held["doc"].combine_chunks()), long_array(held["fp"].combine_chunks())
    out = set(zip(skipped["mark_doc"].to_pylist(), skipped["mark_fp"].to_pylist()))
    keep = np.array([(i, f) not in out for i, f in zip(ids.tolist(), fps.tolist())], bool)
    return utf8(held["text"].combine_chunks().filter(pa.array(keep))), ids[keep], fps[keep]


def _confirm(window: int, phrase: int):
    """One block: its windows with a recurring anchor, each once with its least id, and the phrases of those anchors."""
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        block = key[0].as_py()
        known = np.unique(long_array(marks["mark_anchor"].drop_null().combine_chunks()).view(np.uint64))
        if not len(known) or not docs.num_rows:
            return _FOUND.empty_table()
        texts, ids, _ = _texts(docs, marks.filter(marks["mark_doc"].is_valid()))
        found, phrases = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]], {}
        for first, _, data, bounds in text_pieces(texts):
            w = _Windows(data, bounds, window, phrase)
            hit = known[np.minimum(np.searchsorted(known, w.anchor), len(known) - 1)] == w.anchor
            for place in np.flatnonzero(hit)[_first(w.spot[hit])].tolist():
                value = int(w.anchor[place])
                if value not in phrases:
                    a, b = w.start[w.spot[place]], w.end[w.spot[place] + phrase - 1]
                    phrases[value] = b" ".join(data[a:b].tobytes().split())
            for held, values in zip(found, (w.hash[hit], w.anchor[hit], ids[first + w.doc[hit]])):
                held.append(values)
        hashes, anchors, doc = map(np.concatenate, found)
        order = np.lexsort((doc, anchors, hashes))
        hashes, anchors, doc = (x[order] for x in (hashes, anchors, doc))
        heads = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (anchors[1:] != anchors[:-1])))) if len(hashes) else np.zeros(0, np.int64)
        times = np.minimum(np.diff(np.append(heads, len(hashes))), 2).astype(np.int32)
        return pa.concat_tables([
            _rows(block, len(heads), window=pa.array(hashes[heads].view(np.int64)), short=pa.array(_short(anchors[heads])), doc=pa.array(doc[heads]), times=pa.array(times)),
            _rows(block, len(phrases), anchor=pa.array(np.array(list(phrases), np.uint64).view(np.int64)), phrase=pa.array(list(phrases.values()), pa.binary()))])

    return run


def compile_phrases(phrases: list[bytes]) -> ahocorasick.Automaton:
    """An automaton over single-byte characters; a phrase stands between spaces, so it is met at word bounds only."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ")
    automaton.make_automaton()
    return automaton


def locate(automaton: ahocorasick.Automaton, words: list[bytes]) -> np.ndarray:
    """First word of every occurrence of a phrase of the automaton in ``words``."""
    ends = np.cumsum([len(w) + 1 for w in words])
    hits = np.array([(end, size) for end, size in automaton.iter(" " + b" ".join(words).decode("latin-1") + " ")], np.int64).reshape(-1, 2)
    return np.searchsorted(ends, hits[:, 0] - hits[:, 1] + 1, "right")


_RESULT = pa.schema([("doc", pa.int64()), ("own_fp", pa.int64()), ("n_removed", pa.int64()), ("kept_sha", pa.binary()), ("kept", pa.string())])


def _remove(window: int, phrase: int, with_text: bool):
    """One block: compile its confirmed phrases, locate them in its texts, and drop what windows with an earlier occurrence cover.

    A mark says whether the earliest occurrence of all is this block's own, which then stays.
    """
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        named = marks.filter(marks["mark_phrase"].is_valid())
        sure = marks.filter(marks["mark_window"].is_valid())
        if not sure.num_rows or not docs.num_rows:
            return _RESULT.empty_table()
        hashes, short = long_array(sure["mark_window"].combine_chunks()).view(np.uint64), sure["mark_short"].to_numpy()
        here = sure["mark_here"].to_numpy()
        order = np.lexsort((short, hashes))
        hashes, short, here = hashes[order], short[order], here[order]
        first_doc, first_word = np.full(len(hashes), _LAST), np.full(len(hashes), _LAST)
        anchors = long_array(named["mark_anchor"].combine_chunks()).view(np.uint64)
        automaton = compile_phrases([p for p, keep in zip(named["mark_phrase"].to_pylist(), np.isin(_short(anchors), short).tolist()) if keep])
        texts, ids, fps = _texts(docs, marks.filter(marks["mark_doc"].is_valid()))
        located = []
        for text, doc in zip(texts, ids.tolist()):
            words = text.split()
            spots = locate(automaton, words)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(spots - (window - phrase), 0), 1)
            np.add.at(edge, spots + 1, -1)
            near = np.flatnonzero(np.cumsum(edge[:-1])[:max(len(words) - window + 1, 0)] > 0)
            hits = []
            if len(near):
                w = _Windows(np.frombuffer(b" ".join(words), np.uint8), np.array([0, len(text) + 1]), window, phrase)
                whole, own = w.hash[near], _short(w.anchor[near])
                low, high = np.searchsorted(hashes, whole), np.searchsorted(hashes, whole, "right")
                for step in range(int((high - low).max())):
                    at = np.minimum(low + step, len(hashes) - 1)
                    same = (low + step < high) & (short[at] == own)
                    at, word = at[same], near[same]
                    less = (doc < first_doc[at]) | ((doc == first_doc[at]) & (word < first_word[at]))
                    first_doc[at[less]] = doc
                    first_word[at[less][::-1]] = word[less][::-1]  # of repeats in one text the first is written last
                    hits.append((at, word))
            located.append(hits)
        out = []
        for text, doc, fp, hits in zip(texts, ids.tolist(), fps.tolist(), located):
            later = [word[~here[at] | (first_doc[at] < doc) | (first_word[at] < word)] for at, word in hits]
            later = np.concatenate(later) if later else np.zeros(0, np.int64)
            if not len(later):
                continue
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, later, 1)
            np.add.at(edge, later + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            out.append((doc, fp, int(gone.sum()), hashlib.sha256(kept).digest(), kept.decode() if with_text else None))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, phrase: int = 8, block_bytes: int = 16 << 20, piece_rows: int = 20_000, filter_bits: int = 27, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, unchanged; null has none. Each word is removed that is covered by
    a window of ``window`` words whose sequence starts earlier, in a smaller doc_id or before it in the same one; windows
    are judged on the input. A null id comes after all others; rows of one doc_id count as one document. ``kept`` is the
    kept words joined by one space. A text whose words all equal those of an earlier one goes whole if it has a window.
    ``block_bytes`` is the mean size of a block and ``piece_rows`` of a scanned piece: both bound a task's memory.
    ``filter_bits`` sets the size of the filter, 16 MB, whatever the data's. Windows are compared by 64 bits of their own
    hash and 32 of their anchor's, phrases byte by byte.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("fp", F.xxhash64("text"))
    order: Column = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    whole = cut_lineage(text.mapInArrow(_sequences, "doc_id long, fp long, n_words long, sha binary"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(partitions(docs), -(-int(size) // block_bytes))
    block = F.pmod(F.xxhash64(order), F.lit(blocks))

    same_text = F.xxhash64(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    recurring = cut_lineage(text.select("text", same_text.alias("tag")).mapInArrow(_anchors(window, phrase, piece_rows), "anchor long, low long, high long, twice int")
                            .groupBy("anchor").agg(F.min("low").alias("low"), F.max(F.coalesce("high", "low")).alias("high"), F.max("twice").alias("twice"))
                            .filter("low != high or twice > 0").select("anchor"))
    sent = docs.sparkSession.sparkContext.broadcast(anchor_filter(recurring, filter_bits))
    likely = cut_lineage(text.select(block.alias("block"), order.alias("doc"), "fp", "text")
                         .mapInArrow(_likely(window, phrase, sent, filter_bits), "block long, doc long, fp long, text string, anchors array<bigint>"))

    # Whole repeats: their rows, by part first, so that a hot text meets its earliest copy once per part.
    part = F.pmod(F.xxhash64("doc_id", "fp"), F.lit(blocks))
    earliest = whole.groupBy("sha").agg(F.min(order).alias("earliest"), F.count("*").alias("copies")).filter("copies > 1")
    earliest = cut_lineage(earliest.select("sha", "earliest"))
    per_part = whole.select(part.alias("part"), "sha").distinct().join(earliest, "sha")
    repeat = (F.col("earliest") < order) & (F.col("n_words") >= window)
    whole = cut_lineage(whole.withColumn("part", part).join(per_part, ["part", "sha"], "left")
                        .select("doc_id", "fp", "n_words", "sha", F.coalesce(repeat, F.lit(False)).alias("repeat")))
    skipped = whole.filter("repeat").select(block.alias("mark_block"), order.alias("mark_doc"), F.col("fp").alias("mark_fp"))

    dealt = (likely.select(F.col("block").alias("mark_block"), F.explode("anchors").alias("anchor")).distinct().join(recurring, "anchor", "left_semi")
             .select("mark_block", F.col("anchor").alias("mark_anchor")).unionByName(skipped, allowMissingColumns=True))
    texts = likely.select("block", "doc", "fp", "text")
    found = cut_lineage(texts.groupBy("block").cogroup(dealt.groupBy("mark_block")).applyInArrow(_confirm(window, phrase), _FOUND_DDL))

    same = Window.partitionBy("window", "short")
    marks = (found.filter("window is not null").select("block", "window", "short", "doc", "times")
             .withColumns({"all": F.sum("times").over(same), "first": F.min("doc").over(same)})
             .filter((F.col("all") > 1) & ((F.col("times") > 1) | (F.col("first") != F.col("doc"))))
             .select(F.col("block").alias("mark_block"), F.col("window").alias("mark_window"), F.col("short").alias("mark_short"),
                     (F.col("first") == F.col("doc")).alias("mark_here"))
             .unionByName(found.filter("phrase is not null").select(F.col("block").alias("mark_block"), F.col("anchor").alias("mark_anchor"),
                                                                     F.col("phrase").alias("mark_phrase")), allowMissingColumns=True)
             .unionByName(skipped, allowMissingColumns=True))
    changed = (texts.groupBy("block").cogroup(marks.groupBy("mark_block")).applyInArrow(
        _remove(window, phrase, with_text), "doc long, own_fp long, n_removed long, kept_sha binary, kept string").dropDuplicates(["doc", "own_fp"]))

    repeat = F.col("repeat")
    out = whole.join(changed, (order == F.col("doc")) & (F.col("fp") == F.col("own_fp")), "left")
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    columns = ["doc_id", "n_words", F.when(repeat, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
               F.lower(F.hex(F.when(repeat, nothing).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256")]
    if with_text:
        out = out.join(text.select(F.col("doc_id").alias("text_id"), F.col("fp").alias("text_fp"), "text").dropDuplicates(["text_id", "text_fp"]),
                       F.col("doc_id").eqNullSafe(F.col("text_id")) & (F.col("fp") == F.col("text_fp")))
        plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
        columns.append(F.when(repeat, F.lit("")).otherwise(F.coalesce("kept", plain)).alias("kept"))
    return out.select(*columns)
