"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length, dealt over blocks of bounded size, and each block is
packed at once for all lengths: pieces go, largest first, to the open bin they leave least room in; where none has room
a bin is opened whose length costs least per unit that the block can still put into it; in the end every bin shrinks to
the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import whole_text

LENGTHS = (512, 1024, 2048, 4096, 8192)


def sequence_cost(length: int, overhead: int = 64, largest: int = 8192) -> float:
    """Cost of one sequence: its length, a constant, and attention that grows with the square, equal parts at ``largest``."""
    return overhead + length + length * length / largest


def pack_block(sizes: np.ndarray, lengths: Sequence[int] = LENGTHS, cost=sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and final length of the bin for every piece; ``sizes`` are 1 to the largest length, sorted downwards.

    Of bins with equal room the one opened last is filled first. Of equally cheap lengths the larger is opened.
    """
    lengths = sorted(lengths)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used, room = [], {}
    rooms = 0  # bit r is set while a bin has room r
    left = int(sizes.sum())
    for i, size in enumerate(map(int, sizes)):
        fits = rooms >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = room[free]
            k = stack.pop()
            if not stack:
                rooms &= ~(1 << free)
        else:
            length = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / min(c, left), -c))
            k, free = len(used), length
            used.append(0)
        bins[i], offsets[i] = k, used[k]
        used[k] += size
        free -= size
        if free:
            room.setdefault(free, []).append(k)
            rooms |= 1 << free
        left -= size
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, offsets, final[bins] if used else final


def words_of(text: Column | None = None) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text."""
    return F.regexp_count(whole_text() if text is None else text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _pack(lengths: Sequence[int]):
    def run(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.select(["doc_id", "piece", "piece_start", "piece_size"]).sort_by([("piece_size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, final = pack_block(pieces["piece_size"].to_numpy(), lengths)
        for name, values in (("bin_id", (key[0].as_py() << 32) + bins), ("bin_offset", offsets), ("bin_length", final)):
            pieces = pieces.append_column(name, pa.array(values, pa.int64()))
        return pieces

    return run


def pack(docs: DataFrame, size: Column | None = None, lengths: Sequence[int] = LENGTHS, block_pieces: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, piece_start, piece_size, bin_id, bin_offset, bin_length; units are those of ``size``.

    ``size`` (words of the whole text by default) must depend on ``docs`` alone. Pieces of a document follow one another:
    ``piece_start`` is where a piece begins. A document without units is one row of size 0 with a null bin. Null and
    repeated ids are rows like any other. ``block_pieces`` is the mean size of a block, which one task packs without
    texts; only the last few bins of a block stay partly empty.
    """
    largest = max(lengths)
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words_of() if size is None else size, F.lit(0)).cast("long").alias("total")))
    pieces = (sized.filter("total > 0").select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {largest}"))).alias("piece"))
              .select("doc_id", "piece", (F.col("piece") * largest).alias("piece_start"), F.least(F.lit(largest), F.col("total") - F.col("piece") * largest).alias("piece_size")))
    count = sized.agg(F.sum(F.ceil(F.col("total") / largest))).first()[0] or 0
    blocks = max(1, -(-int(count) // block_pieces))
    packed = (pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "piece_size"), F.lit(blocks))).groupBy("block")
              .applyInArrow(_pack(lengths), "doc_id long, piece long, piece_start long, piece_size long, bin_id long, bin_offset long, bin_length long"))
    empty = sized.filter("total = 0").select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("piece", "piece_start", "piece_size")),
                                             F.lit(None).cast("long").alias("bin_id"), *(F.lit(0).cast("long").alias(c) for c in ("bin_offset", "bin_length")))
    return packed.unionByName(empty)
