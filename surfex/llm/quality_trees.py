"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy from binned statistics of a bounded sample of labelled rows, then flattened into complete
binary arrays (feature, threshold, leaf) that are walked for all documents of a batch and all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_pieces, utf8, whole_text, word_hashes

STATISTICS = ("log_words", "word_bytes", "longest_word", "short_words", "distinct_words", "commonest_word", "same_as_previous", "symbols",
              "digits", "capitals", "full_stops", "exclamations", "bars", "not_ascii", "words_per_line", "repeated_lines")

_CLASSES = [np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for chars in
            (b"#*$%&<>", b"0123456789", bytes(range(65, 91)), b".,;:?", b"!", b"|", bytes(range(128, 256)))]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` per whole text; all zero for a text without words."""
    return np.concatenate([_statistics(data, bounds) for _, _, data, bounds in text_pieces(texts)] or [np.zeros((0, len(STATISTICS)))])


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    docs = len(bounds) - 1
    start, end, hashes = word_hashes(data)
    doc = np.searchsorted(bounds, start, "right") - 1
    length = (end - start).astype(float)
    n = np.bincount(doc, minlength=docs).astype(float)
    per_word = np.maximum(n, 1)
    total = np.bincount(doc, length, docs)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    firsts = np.flatnonzero(new)
    runs, run_doc = np.diff(np.append(firsts, len(order))), doc[order][firsts]
    commonest = np.zeros(docs)
    np.maximum.at(commonest, run_doc, runs)
    same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    symbols, digits, capitals, stops, exclamations, bars, wide = (np.add.reduceat(c[data].astype(np.int64), bounds[:-1]) for c in _CLASSES)
    lines, repeated = np.zeros(docs), np.zeros(docs)
    for i in range(docs):
        own = [x for x in data[bounds[i]:bounds[i + 1] - 1].tobytes().split(b"\n") if x]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
    size = np.maximum(total, 1)
    out = np.column_stack([
        np.log1p(n), total / per_word, longest, np.bincount(doc, length <= 3, docs) / per_word, np.bincount(run_doc, minlength=docs) / per_word,
        commonest / per_word, np.bincount(doc[1:], same, docs) / per_word, symbols / per_word, digits / size, capitals / size, stops / per_word,
        exclamations / per_word, bars / per_word, wide / size, n / np.maximum(lines, 1), repeated / np.maximum(lines, 1)])
    out[n == 0] = 0
    return out


@dataclass(frozen=True)
class Trees:
    """``feature`` and ``threshold`` are (trees, 2^depth - 1), ``leaf`` is (trees, 2^depth); ``base`` is the first log-odds."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``; all trees of a batch step down together."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - self.feature.shape[1]].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0,
         least: float = 2.0) -> Trees:
    """Boost ``trees`` trees on logistic loss. Without rows, or with one label only, the result is the smoothed prior."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner = 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    width, columns = bins + 1, x.shape[1]
    raw = np.full(len(y), base)
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * columns + np.arange(columns)) * width + binned
            shape = (nodes, columns, width)
            g, h = (np.bincount(cell.ravel(), np.repeat(v, columns), nodes * columns * width).reshape(shape).cumsum(2) for v in (gradient, weight))
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (whole_g - g)**2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
            gain[(h < least) | (whole_h - h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-9):
                f, b = divmod(int(best[k]), width)
                if b < len(edges[f]):
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - inner
        leaf = rate * np.bincount(place, gradient, inner + 1) / (np.bincount(place, weight, inner + 1) + ridge)
        raw = raw + leaf[place]
        for rows, value in zip(out, (feature, threshold, leaf)):
            rows.append(value)
    return Trees(depth, base, *map(np.array, out))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **growth: float) -> Trees:
    """Trees learnt from at most ``max_rows`` labelled documents that are not held out.

    The sample is the ``max_rows`` smallest hashes of doc_id, so it is the same in every run; it alone reaches the
    driver, as ``max_rows`` vectors. Null ids and labels other than 0 and 1 are ignored; of repeated labels the larger
    counts. Every row of a repeated doc_id is learnt from, up to the bound.
    """
    chosen = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").cast("int").alias("label"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    vectors = F.arrow_udf(lambda text: pa.array(list(statistics(utf8(text))), pa.list_(pa.float64())), "array<double>")
    # The chosen ids are max_rows at most, whatever the tables hold, so they may be sent to every task.
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
            .select("doc_id", "label", F.xxhash64("text").alias("order"), vectors("text").alias("x"))
            .orderBy("doc_id", "order").limit(max_rows).collect())
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return grow(x, np.array([r["label"] for r in rows], float), **growth)


def score(text: Column, model: Trees) -> Column:
    """Score of each whole text, 0 to 1, higher where label 1 is likelier; null counts as empty."""
    return F.arrow_udf(lambda t: pa.array(model.score(statistics(utf8(t))), pa.float64()), "double")(text)


def classify(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Empty tables give empty results or the prior."""
    model = fit(docs, labels, **options)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(whole_text(), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that the trees accept, with all their columns."""
    return docs.filter(score(whole_text(), fit(docs, labels, **options)) >= 0.5)
