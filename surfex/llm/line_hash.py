"""Line dedup through sharded minimal perfect hashes.

Pieces of documents send the 128-bit hashes of their distinct lines, each with the number of documents that hold it, to
the shards of the hash space. A shard lays a minimal perfect hash over its distinct lines and keeps two arrays in its
order: a compact fingerprint, which tells lines that the index has never met, and the count of documents. Documents then
probe the arrays: a piece sends the hashes of its lines, the shard reads their slots and returns the places of lines to
drop. No row stands for a line anywhere, and a line that every document holds is one hash per piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import in_pieces, mix, partitions, utf8, whole_text

_PIECE = "probe boolean, block long, shard int, hashes binary, places binary, documents binary, doc_id {id}, text_key binary, lines binary"
_INDEX = "shard int, n_lines long, levels array<int>, bits binary, prints binary, counts binary"


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys, given as two uint64 columns.

    Keys that hash to a place of their own in a bit array of twice their number stay there; the others go on to the next
    array. The slot of a key is the number of bits set before its place, over all arrays.
    """

    def __init__(self, levels: np.ndarray, bits: np.ndarray):
        self.levels, self.bits = levels.astype(np.int64), bits
        self.starts = np.concatenate(([0], np.cumsum(self.levels)))
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            return (mix(keys[:, 0] ^ mix(keys[:, 1] + seed)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, parts = [], []
        while len(keys):
            size = -(-2 * len(keys) // 8) * 8
            at = cls.place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little"))
            levels.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(levels, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; a key outside the index gets the slot of another key, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.levels.tolist()):
            at = self.starts[level] + self.place(keys[left], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            before = np.bitwise_count(self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[hit]] = (self.ranks[byte] + before)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def _prints(keys: np.ndarray) -> np.ndarray:
    """32-bit fingerprints, of other bits than the places are made from."""
    with np.errstate(over="ignore"):
        return (mix(keys[:, 0] + np.uint64(3) * keys[:, 1]) >> np.uint64(32)).astype(np.uint32)


def _keys(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64).reshape(-1, 2)


def _pieces(shards: int, min_chars: int, schema: pa.Schema, max_bytes: int):
    """Per piece: one row for every shard its lines fall in, one row for every document that has a line with a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for piece in in_pieces(batches, 16_384, max_bytes):
            known: dict[bytes, int] = {}
            held, texts = [], utf8(piece["text"])
            for text in texts:
                own = []
                for line in text.split(b"\n"):
                    key = line.strip().lower()
                    if not key or min_chars > 1 and len(key.decode()) < min_chars:
                        own.append(-1)
                    else:
                        own.append(known.setdefault(hashlib.blake2b(key, digest_size=16).digest(), len(known)))
                held.append(np.array(own, np.int32))
            if known:
                keys = _keys(b"".join(known))
                documents = np.zeros(len(keys), np.int64)
                for own in held:
                    documents[np.unique(own[own >= 0])] += 1
                shard = ((keys[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                ends = np.flatnonzero(np.diff(shard[order], append=shards)) + 1
                runs = [order[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends)]
                has = [i for i, own in enumerate(held) if (own >= 0).any()]
                n, m = len(runs), len(has)
                columns = {
                    "probe": [True] * n + [False] * m, "block": [block] * (n + m), "shard": [int(shard[r[0]]) for r in runs] + [None] * m,
                    "hashes": [keys[r].tobytes() for r in runs] + [None] * m, "places": [r.astype(np.int32).tobytes() for r in runs] + [None] * m,
                    "documents": [documents[r].tobytes() for r in runs] + [None] * m,
                    "doc_id": pa.concat_arrays([pa.nulls(n, schema.field("doc_id").type), piece["doc_id"].combine_chunks().take(pa.array(has, pa.int64()))]),
                    "text_key": [None] * n + piece["text_key"].take(pa.array(has, pa.int64())).to_pylist(), "lines": [None] * n + [held[i].tobytes() for i in has]}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)
            block += 1

    return run


def cut_lines(docs: DataFrame, min_chars: int = 1, max_bytes: int = 4 << 20) -> DataFrame:
    """The line hashes of ``docs`` (doc_id, text), as ``build_index`` and ``probe_index`` read them; a written table.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points (1 at least) are left out. ``max_bytes`` bounds the texts of a piece.
    """
    if min_chars < 1:
        raise ValueError("min_chars must be 1 or more: an empty key is no line to count")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _PIECE.format(id=kind)
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("text_key", F.unhex(F.sha2("text", 256)))
    return cut_lineage(texts.mapInArrow(_pieces(partitions(docs), min_chars, to_arrow_schema(StructType.fromDDL(schema)), max_bytes), schema))


def _build(batch: pa.Table) -> pa.Table:
    keys = np.concatenate([_keys(b) for b in batch["hashes"].to_pylist()])
    documents = np.concatenate([np.frombuffer(b, np.int64) for b in batch["documents"].to_pylist()])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, documents = keys[order], documents[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    keys, documents = keys[first], np.add.reduceat(documents, first)
    index = PerfectHash.build(keys)
    slot = index.slots(keys)
    prints, counts = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
    prints[slot], counts[slot] = _prints(keys), np.minimum(documents, 2**32 - 1)
    return pa.table({"shard": pa.array(batch["shard"][:1].to_pylist(), pa.int32()), "n_lines": pa.array([len(keys)], pa.int64()),
                     "levels": pa.array([index.levels.tolist()], pa.list_(pa.int32())), "bits": pa.array([index.bits.tobytes()], pa.binary()),
                     "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def build_index(cut: DataFrame) -> DataFrame:
    """(shard, n_lines, levels, bits, prints, counts): one row per shard that has lines, written to the shared folder.

    ``cut`` is what ``cut_lines`` returns. About nine bytes per distinct line; counts saturate at 2^32 - 1. A task holds
    the messages of one shard, 24 bytes per piece and line; size the shuffle partitions, which are the shards, so that
    these fit.
    """
    return cut_lineage(cut.filter("probe").groupBy("shard").applyInArrow(_build, _INDEX))


def _probe(min_documents: int):
    schema = pa.schema([("block", pa.int64()), ("gone", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, prints, counts = None, None, None, None
        for batch in batches:
            blocks, gone = [], []
            for row in batch.to_pylist():
                if row["bits"] is not None:
                    at, index = row["shard"], PerfectHash(np.array(row["levels"]), np.frombuffer(row["bits"], np.uint8))
                    prints, counts = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                elif row["shard"] == at:
                    keys = _keys(row["hashes"])
                    slot = index.slots(keys)
                    hit = (slot >= 0) & (prints[slot] == _prints(keys)) & (counts[slot] >= min_documents)
                    if hit.any():
                        blocks.append(row["block"])
                        gone.append(np.frombuffer(row["places"], np.int32)[hit].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(gone, pa.binary())], schema=schema)

    return run


def _answers(schema: pa.Schema):
    """Replies of a piece come before its documents; only documents that lose a line get a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, gone = None, []
        for batch in batches:
            take, marks = [], []
            for i, (b, reply, lines) in enumerate(zip(batch["block"].to_pylist(), batch["gone"].to_pylist(), batch["lines"].to_pylist())):
                if b != block:
                    block, gone = b, []
                if reply is not None:
                    gone.append(np.frombuffer(reply, np.int32))
                elif gone:
                    gone = [np.concatenate(gone)] if len(gone) > 1 else gone
                    own = np.isin(np.frombuffer(lines, np.int32), gone[0])
                    if own.any():
                        take.append(i)
                        marks.append(own.tolist())
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(rows), batch["text_key"].take(rows), pa.array(marks, pa.list_(pa.bool_()))], schema=schema)

    return run


def probe_index(cut: DataFrame, index: DataFrame, min_documents: int = 10) -> DataFrame:
    """(doc_id, text_key, gone array<boolean>) of documents with a line that ``index`` counts in ``min_documents`` or more.

    ``cut`` may come from other documents than the index; a line that the index has never met is then taken for a known
    one with a chance of 2^-32. ``gone`` has one entry per line. Cut both with equally many shuffle partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    n = partitions(cut)
    messages = cut.filter("probe").select("shard", "block", "hashes", "places")
    met = index.unionByName(messages, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", F.col("bits").isNull())
    replies = met.mapInArrow(_probe(min_documents), "block long, gone binary")
    schema = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, text_key binary, gone array<boolean>"
    both = (replies.unionByName(cut.filter("NOT probe").select("block", "doc_id", "text_key", "lines"), allowMissingColumns=True)
            .repartition(n, "block").sortWithinPartitions("block", F.col("gone").isNull()))
    return both.mapInArrow(_answers(to_arrow_schema(StructType.fromDDL(schema))), schema)


def mark_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, index: DataFrame | None = None, max_bytes: int = 4 << 20) -> DataFrame:
    """(row, gone): every row of ``docs`` as one struct, with a mark for each of its lines, or null where none goes.

    Lines whose key is found in ``min_documents`` rows or more go, all of them in every document; with ``index`` its counts
    decide instead of those of ``docs``. Null texts count as empty, which is one empty line; empty keys never go. A
    document is a row: rows that repeat an id or a text count each. Lines are told apart by 128-bit hashes.
    """
    cut = cut_lines(docs, min_chars, max_bytes)
    found = probe_index(cut, build_index(cut) if index is None else index, min_documents)
    found = cut_lineage(found.dropDuplicates(["doc_id", "text_key"]))
    rows = docs.select(F.struct("*").alias("row")).withColumn("own", F.unhex(F.sha2(F.coalesce("row.text", F.lit("")), 256)))
    return rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("text_key")), "left").select("row", "gone")


def dedup_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, **how) -> DataFrame:
    """doc_id, n_lines before dropping, n_dropped and the kept text, one row per row of ``docs``; rules in ``mark_lines``."""
    marked = mark_lines(docs, min_documents, min_chars, **how).select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "gone")
    return marked.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
                         F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).cast("long").alias("n_dropped"), _kept().alias("kept"))


def drop_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, **how) -> DataFrame:
    """All rows and columns of ``docs``, the texts without their dropped lines; a null text stays null. Rules in ``mark_lines``."""
    kept = mark_lines(docs, min_documents, min_chars, **how).withColumn("text", F.col("row.text"))
    return kept.select(*[(_kept() if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def _kept():
    lines = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.col("gone")[i])
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
