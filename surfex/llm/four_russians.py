"""Hard-negative mining with Four-Russians scoring.

A score is the integer inner product of an anchor and a candidate. Candidates are packed as bit planes: bit b of eight
neighbouring dimensions is one byte. For an anchor the sums of all 256 subsets of each eight dimensions are laid down in a
table; a candidate's byte looks up what its bit plane adds there, and the planes are combined by shift and add into the
full, exact score. Blocks of anchors meet blocks of candidates, twice: once for each anchor's positives, then for the
negatives in the band below each positive. Only the best few rows of each block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import in_pieces, partitions

_PACKED = "piece long, ids binary, labels binary, planes int, dims int, bits binary"
#: Anchors whose tables lie side by side, and candidates scored against them at once: both fit the processor's cache.
_ANCHORS, _CANDIDATES = 64, 2048


def pack_planes(vectors: np.ndarray) -> np.ndarray:
    """Bit planes (planes, dims / 8, n) of int64 ``vectors`` (n, dims), dims a multiple of 8, in two's complement.

    Bit k of a byte is dimension 8 * group + k. There are as many planes as the largest value needs; the last holds signs.
    """
    most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)) - 1)
    planes = min(64, most.bit_length() + 1)
    bits = np.empty((planes, vectors.shape[1] // 8, len(vectors)), np.uint8)
    raw = vectors.view(np.uint64)
    for b in range(planes):
        plane = ((raw >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        bits[b] = np.packbits(plane, axis=1, bitorder="little").T
    return bits


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Table (dims / 8, 256, n): sum of the chosen ones of eight neighbouring dimensions of ``anchors`` (n, dims)."""
    n, dims = anchors.shape
    groups = anchors.T.reshape(dims // 8, 8, n).astype(kind)
    table = np.zeros((dims // 8, 256, n), kind)
    for k in range(8):
        table[:, 1 << k:2 << k] = table[:, :1 << k] + groups[:, k:k + 1]
    return table


def scores(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact inner products (candidates, anchors); sums wrap at the width of ``table``, as long arithmetic does."""
    planes, groups, n = bits.shape
    groups = min(groups, len(table))
    total = np.zeros((n, table.shape[2]), table.dtype)
    part = np.empty_like(total)
    with np.errstate(over="ignore"):
        for b in range(planes - 1, -1, -1):
            if b < planes - 1:
                total += total
            for g in range(groups):
                np.take(table[g], bits[b, g], axis=0, out=part, mode="clip")
                total += part
            if b == planes - 1:  # the sign plane counts negatively
                np.negative(total, out=total)
    return total


def _pack(block_rows: int):
    schema = pa.schema([("piece", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("planes", pa.int32()), ("dims", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_pieces(batches, block_rows):
            ids, labels = (rows[c].to_numpy().astype(np.int64) for c in ("vec_id", "label"))
            vectors = _matrix(rows["vector"])
            bits = pack_planes(vectors)
            yield pa.RecordBatch.from_arrays([
                pa.array([int(ids[0])], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()),
                pa.array([len(bits)], pa.int32()), pa.array([vectors.shape[1]], pa.int32()), pa.array([bits.tobytes()], pa.binary())], schema=schema)

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as int64 rows, shorter ones filled up with zeros, to a multiple of eight dimensions."""
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), -(-int(sizes.max(initial=1) or 1) // 8) * 8), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _pieces(candidates: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and bit planes, at most ``_CANDIDATES`` at a time."""
    for row in candidates.to_pylist():
        ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        bits = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], row["dims"] // 8, len(ids))
        for a in range(0, len(ids), _CANDIDATES):
            yield ids[a:a + _CANDIDATES], labels[a:a + _CANDIDATES], np.ascontiguousarray(bits[:, :, a:a + _CANDIDATES])


def _width(vectors: np.ndarray, candidates: pa.Table) -> type:
    """int32 where no score can leave it."""
    planes = max(candidates["planes"].to_pylist())
    largest = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
    return np.int32 if (largest * vectors.shape[1]) << planes < 2**31 else np.int64


def _best(score: np.ndarray, ids: np.ndarray, few: int) -> np.ndarray:
    """Places of the first ``few`` by score, highest first, ties by smaller id."""
    if len(score) > 4 * few:
        floor = np.partition(score, len(score) - few)[len(score) - few]
        near = np.flatnonzero(score >= floor)
        return near[np.lexsort((ids[near], ~score[near]))[:few]]
    return np.lexsort((ids, ~score))[:few]


class _Top:
    """The first ``few`` (score, id) of what it has been offered."""

    def __init__(self, few: int):
        self.few, self.score, self.ids = few, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.few:
            good = score >= self.score[-1]
            if not good.any():
                return
            score, ids = score[good], ids[good]
        score, ids = np.concatenate((self.score, score.astype(np.int64))), np.concatenate((self.ids, ids))
        order = _best(score, ids, self.few)
        self.score, self.ids = score[order], ids[order]


def _scan(anchors: pa.Table, candidates: pa.Table):
    """Every anchor's (place, candidate ids, their labels, scores), block by block."""
    vectors = _matrix(anchors["vector"])
    kind = _width(vectors, candidates)
    for first in range(0, len(vectors), _ANCHORS):
        table = subset_sums(vectors[first:first + _ANCHORS], kind)
        for ids, labels, bits in _pieces(candidates):
            total = np.ascontiguousarray(scores(table, bits).T)
            for i in range(len(total)):
                yield first + i, ids, labels, total[i]


def _positives(few: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return schema.empty_table()
        own, label = anchors["vec_id"].to_pylist(), anchors["label"].to_pylist()
        top = [_Top(few) for _ in own]
        for i, ids, labels, score in _scan(anchors, candidates):
            fit = (labels == label[i]) & (ids != own[i])
            top[i].offer(score[fit], ids[fit])
        return pa.table([np.repeat(np.array(own, np.int64), [len(t.ids) for t in top]), np.concatenate([t.ids for t in top]), np.concatenate([t.score for t in top])], schema=schema)

    return run


def _negatives(few: int, low: int, high: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return schema.empty_table()
        own, label, wanted = anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["positives"].to_pylist()
        # Positives of equal score have the same band.
        bands = [{p["positive_score"]: (-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in w} for w in wanted]
        tops = [{s: _Top(few) for s in b} for b in bands]
        for i, ids, labels, score in _scan(anchors, candidates):
            fit = labels != label[i]
            score, ids = score[fit], ids[fit]
            for s, (least, most) in bands[i].items():
                inside = (score >= max(least, -2**63)) & (score <= min(most, 2**63 - 1)) if least <= most else np.zeros(len(score), bool)
                if inside.any():
                    tops[i][s].offer(score[inside], ids[inside])
        rows = [(own[i], p["positive_id"], p["positive_score"], int(n), int(s)) for i, w in enumerate(wanted) for p in w
                for n, s in zip(tops[i][p["positive_score"]].ids, tops[i][p["positive_score"]].score)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema) if rows else schema.empty_table()

    return run


def quantise(vectors: DataFrame, factor: int = 256, column: str = "embedding") -> DataFrame:
    """(vec_id long, label long, vector array<long>): components become floor(factor * x), x as double.

    Rows with a null id, label, vector or component, or a component that is not finite, are left out. A component
    beyond the range of a long becomes the nearest long. Rows that repeat an id are one row, the least of them by
    (label, vector).
    """
    limit = 2.0**63
    x = F.transform(F.col(column), lambda v: F.floor(F.greatest(F.least(v.cast("double") * factor, F.lit(limit)), F.lit(-limit)).cast("double")).cast("long"))
    odd = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull()).filter(~odd)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("vector"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 4096,
         anchor_rows: int = 16_384, cell_pieces: int = 16) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    ``vectors`` is what ``quantise`` returns; ids are distinct. Anchors are the rows whose id ``every`` divides; an anchor's
    positives are its first ``positives`` other rows of its label, and for each of them the negatives are the first
    ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores
    come first, ties by smaller id. Shorter vectors count as filled up with zeros; scores wrap as longs do. An anchor
    without positives, or a positive without negatives, has no row.

    Every candidate is scored against every anchor. A task holds about ``anchor_rows`` anchors and ``cell_pieces`` pieces of ``block_rows``
    candidates, whatever their labels and ids; hashes deal them out.
    """
    vectors = cut_lineage(vectors.select("vec_id", "label", "vector"))
    pieces = cut_lineage(vectors.repartition(max(partitions(vectors), -(-vectors.count() // block_rows)), "vec_id").mapInArrow(_pack(block_rows), _PACKED))
    anchors = vectors.filter(F.col("vec_id") % every == 0)
    n, m = pieces.count(), anchors.count()
    if not n or not m:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    tasks = partitions(vectors)
    rows, columns = -(-m // anchor_rows), min(n, max(tasks, -(-n // cell_pieces)))
    cells = max(tasks, rows * columns)
    cell = F.pmod(F.xxhash64("piece"), F.lit(columns)).cast("int").alias("column")
    dealt = pieces.select("*", cell, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("line")).repartition(cells, "line", "column")

    def against(queries: DataFrame, fn, schema: str) -> DataFrame:
        lines = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
        return (lines.repartition(cells, "line", "column").groupBy("line", "column").cogroup(dealt.groupBy("line", "column"))
                .applyInArrow(fn, schema))

    def first(found: DataFrame, keys: list[str], score: str, other: str, few: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)

    near = first(against(anchors, _positives(positives), "anchor_id long, positive_id long, positive_score long"), ["anchor_id"], "positive_score", "positive_id", positives)
    # At most ``positives`` entries a list.
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    queries = cut_lineage(anchors.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id"))
    found = against(queries, _negatives(negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
