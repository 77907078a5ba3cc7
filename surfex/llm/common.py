"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_text(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which a user sizes to the data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def long_array(column: pa.Array) -> np.ndarray:
    """A long column as numpy; nulls become 0, so carry a null mask where null counts."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def in_pieces(batches: Iterator[pa.RecordBatch], max_rows: int, max_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Rows of one partition in tables of at most ``max_rows`` rows, each ended once its texts reach ``max_bytes``."""
    held, rows, size = [], 0, 0
    for batch in batches:
        texts = batch.column("text") if "text" in batch.schema.names else None
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) if texts is not None else np.zeros(batch.num_rows, np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + max_bytes - size)) + 1, at + max_rows - rows, batch.num_rows)
            held.append(batch.slice(at, to - at))
            rows, size, at = rows + to - at, size + int(ends[to - 1]) - before, to
            if rows >= max_rows or size >= max_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    v = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xD1B54A32D192ED03)
        v ^= v >> np.uint64(32)
    return v


PIECE_BYTES = 1 << 20


def text_pieces(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``PIECE_BYTES``: first and last index, their bytes each ended by a newline, and the bounds.

    Text i of the run is ``data[bounds[i]:bounds[i + 1] - 1]``; a text longer than that is a run of its own.
    """
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= PIECE_BYTES or i == len(texts) - 1:
            run = texts[first:i + 1]
            bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in run])))
            yield first, i + 1, np.frombuffer(b"\n".join(run) + b"\n", np.uint8), bounds
            first, held = i + 1, 0


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2^64, grown on demand and kept by the worker."""
    if len(_POWERS[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of UTF-8 ``data`` (uint8).

    The hash is a polynomial of the word's bytes, read off prefix sums and shifted back by the inverse power, so the
    same word has the same hash wherever it stands. Long data goes in pieces cut between words, so the powers stay as
    short as a piece or the longest word.
    """
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if len(data) > PIECE_BYTES:
        parts, at = [], 0
        while at < len(data):
            ahead = np.flatnonzero(space[at + PIECE_BYTES // 2:at + PIECE_BYTES])
            if len(ahead):
                to = at + PIECE_BYTES // 2 + int(ahead[0]) + 1
            else:
                later = np.flatnonzero(space[at + PIECE_BYTES:])
                to = at + PIECE_BYTES + int(later[0]) + 1 if len(later) else len(data)
            parts.append((at, _hashes(data[at:to], space[at:to])))
            at = to
        return tuple(np.concatenate([p[i] + at if i < 2 else p[i] for at, p in parts]) for i in range(3))
    return _hashes(data, space)


def _hashes(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        return start, end, mix((total[end] - total[start]) * down[start])


def word_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; empty where there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xC6A4A7935BD1E995) + hashes[k:k + size]
    return mix(out)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node of its connected component.

    Large-star and small-star steps in turn: every node's larger neighbours, then its smaller ones, are linked to its
    least neighbour, until nothing changes. Least neighbours are pre-aggregated; edges meet them in a join of two
    written tables, so adaptive execution can split a hub. Loops and repeated links do no harm.
    """
    from surfex.session import cut_lineage

    edges = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        edges = cut_lineage(small)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
