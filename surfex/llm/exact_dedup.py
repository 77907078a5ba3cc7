"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every block of rows sorts its distinct 64-bit fingerprints and sends them, Golomb-Rice coded, to the owners of the
hash ranges; an owner sends back one bitmap per block that marks the fingerprints seen in more than one block. Only
rows so marked, or repeated within their own block, are suspects: their texts alone are grouped, byte by byte. A hot
text sends one code per block, is pre-aggregated before its shuffle, and comes back to its rows through one row per
block, so no task gets a group whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import in_pieces, long_array, partitions, whole_text

_SKETCH = ("message boolean, block long, owner int, doc_id long, fp long, sha binary, rank int, local boolean, again boolean, "
           "n int, base long, k int, unary binary, rest binary")


def rice_encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Base, parameter, unary stream and remainder stream of sorted, distinct uint64 ``values`` (one at least)."""
    gaps = np.diff(values, prepend=values[:1])
    mean = int(values[-1] - values[0]) // len(values)
    k = max(0, mean.bit_length() - 1)
    quotients = gaps >> np.uint64(k)
    ends = np.cumsum(quotients + np.uint64(1)).astype(np.int64)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return int(values[:1].view(np.int64)[0]), k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def rice_decode(n: int, base: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The values that ``rice_encode`` was given."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * k].reshape(n, k).astype(np.uint64)
        gaps |= bits @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    with np.errstate(over="ignore"):
        return np.cumsum(gaps, dtype=np.uint64) + np.array([base], np.int64).view(np.uint64)


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each uint64 value: equal ranges of the hash space, in order."""
    return (((values >> np.uint64(40)) * np.uint64(owners)) >> np.uint64(24)).astype(np.int32)


def _sketch(owners: int, block_rows: int):
    schema = pa.schema([("message", pa.bool_()), ("block", pa.int64()), ("owner", pa.int32()), ("doc_id", pa.int64()), ("fp", pa.int64()),
                        ("sha", pa.binary()), ("rank", pa.int32()), ("local", pa.bool_()), ("again", pa.bool_()), ("n", pa.int32()),
                        ("base", pa.int64()), ("k", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        for piece, table in enumerate(in_pieces(batches, block_rows)):
            block = first + piece
            ids, known = long_array(table["doc_id"].combine_chunks()), table["doc_id"].is_valid().to_numpy()
            values = long_array(table["fp"].combine_chunks()).view(np.uint64)
            order = np.lexsort((ids, known, values))
            values, ids, known = values[order], ids[order], known[order]
            new = np.concatenate(([True], values[1:] != values[:-1]))
            again = np.concatenate(([False], ~new[1:] & (ids[1:] == ids[:-1]) & (known[1:] == known[:-1])))
            single = values[new]
            place = np.cumsum(new) - 1
            owner = owner_of(single, owners)
            cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rank = np.arange(len(single)) - np.repeat(cuts, np.diff(np.append(cuts, len(single))))
            local = np.bincount(place) > 1
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, bool)), pa.array(np.full(n, block)), pa.array(owner[place]), pa.array(ids, mask=~known),
                 pa.array(values.view(np.int64)), table["sha"].combine_chunks().take(pa.array(order)).cast(pa.binary()),
                 pa.array(rank[place].astype(np.int32)), pa.array(local[place]), pa.array(again),
                 *(pa.nulls(n, schema.field(i).type) for i in range(9, 14))], schema=schema)
            sent = []
            for a, b in zip(cuts, np.append(cuts[1:], len(single))):
                sent.append((int(owner[a]), b - a, *rice_encode(single[a:b])))
            m, parts = len(sent), list(zip(*sent))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(m, bool)), pa.array(np.full(m, block)), pa.array(parts[0], pa.int32()),
                 *(pa.nulls(m, schema.field(i).type) for i in range(3, 9)), pa.array(parts[1], pa.int32()),
                 pa.array(parts[2], pa.int64()), pa.array(parts[3], pa.int32()), pa.array(parts[4], pa.binary()),
                 pa.array(parts[5], pa.binary())], schema=schema)

    return run


def _bitmaps(key: tuple, messages: pd.DataFrame) -> pd.DataFrame:
    """Owner's answer: per block, a bit for each of its sorted fingerprints that another block sent too."""
    codes = [rice_decode(*row) for row in messages[["n", "base", "k", "unary", "rest"]].itertuples(index=False)]
    everything = np.sort(np.concatenate(codes))
    shared = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for block, values in zip(messages["block"], codes):
        hits = np.isin(values, shared, assume_unique=True)
        if hits.any():
            out.append((int(block), int(key[0]), np.packbits(hits, bitorder="little").tobytes()))
    return pd.DataFrame(out, columns=["block", "owner", "bits"])


def find_copies(docs: DataFrame, owners: int | None = None, block_rows: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, fp.

    Texts are equal when their bytes are; a null text counts as empty. The largest doc_id of equal texts stays; a null
    doc_id stays only in a group without any other. Of repeated rows with that doc_id exactly one is kept. Other columns
    of ``docs`` are not read. ``owners`` (by default the shuffle partitions) sets how much one owner decodes;
    ``block_rows`` bounds what one block holds in memory. An empty input gives an empty result.
    """
    owners = owners or partitions(docs)
    text = whole_text()
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), F.unhex(F.sha2(text, 256)).alias("sha"))
    sketch = cut_lineage(prints.mapInArrow(_sketch(owners, block_rows), _SKETCH))
    rows = sketch.filter(~F.col("message")).select("block", "owner", "doc_id", "fp", "sha", "rank", "local", "again")
    bitmaps = (sketch.filter("message").select("block", "owner", "n", "base", "k", "unary", "rest")
               .groupBy("owner").applyInPandas(_bitmaps, "block long, owner int, bits binary"))

    byte = F.conv(F.hex(F.substr("bits", (F.col("rank") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(byte, rank % 8) & 1") == 1
    suspects = cut_lineage(rows.join(bitmaps, ["block", "owner"], "left").withColumn("byte", byte)
                           .filter(F.col("local") | F.coalesce(marked, F.lit(False))).select("block", "doc_id", "fp", "sha"))

    asked = suspects.select(F.col("doc_id").alias("asked_id"), F.col("fp").alias("asked_fp")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("fp"))
    verified = (texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("fp") == F.col("asked_fp")), "left_semi")
                .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                .filter("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    per_block = suspects.groupBy("block", "sha").agg(F.max("doc_id").alias("top_id"))
    holder = F.max(F.when(F.col("top_id").eqNullSafe(F.col("keep_id")), F.col("block"))).over(Window.partitionBy("sha"))
    answers = per_block.join(verified, "sha").select("block", "sha", "keep_id", "group_size", holder.alias("holder"))
    found = F.col("group_size").isNotNull()
    return (rows.join(answers, ["block", "sha"], "left")
            .select("doc_id", F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (~found | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again") & (F.col("block") == F.col("holder")))).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "fp"))


def drop_copies(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``find_copies``."""
    report = find_copies(docs, **options)
    gone = cut_lineage(report.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp"),
                                                            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("repeated")))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("fp"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("fp") == F.col("gone_fp"))
    repeated = gone.filter("repeated").distinct()
    return (keyed.join(gone, same, "left_anti")
            .unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["id", "fp"])).select("row.*"))
