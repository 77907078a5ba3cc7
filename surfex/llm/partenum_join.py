"""N-gram Jaccard join by PartEnum signatures.

Shingle sets are put into size bands. Two sets of a band that are similar enough differ in at most k shingles, so if the
feature domain is dealt into more than k / 2 parts, some part holds at most one difference; each part is dealt into three,
and the three ways to leave one out are its signatures. Similar sets share at least one signature. Sets that share one
are candidates, compared exactly.

A signature without features would be shared by chance, so none is made: there are a few more parts than needed, and a set
with more parts of that kind than spare ones is dealt again, by another hash, until it has fewer. Two similar sets meet in
the last dealing of the one that is dealt less often: it has a good part whose signatures all have features.

Equal sets are one class. The class that meets most others leads its buckets, and all buckets of one leader are one
cluster, so a group of near copies meets once instead of once a signature. A cluster is cut into blocks of bounded size,
each with the leader's set; a task compares all classes of a block in place, by products of 0/1 matrices, and returns only
the edges that connect them. Where a cluster has several blocks and its classes are not yet one component, the pairs of
blocks follow; two blocks that hold the same single component are left out. No pair of classes that share a signature is
lost, no pair is a row, and a group of linked near copies costs about one comparison with its leader's block per class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surfex.session import cut_lineage, drop_cut

from .common import components, in_pieces, long_array, mix, text_pieces, utf8, whole_text, word_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PARTS = 3  # second-level parts, of which one is left out
_RUN = 1 << 17  # shingles dealt at once, unless one set has more
_BITS = np.uint64((1 << 48) - 1)  # of a signature; a chance meeting only costs a comparison


@lru_cache
def bands(percent: int, largest: int) -> tuple[tuple[int, int, int], ...]:
    """(least size, largest size, most differences) of each band up to size ``largest``; a band spans as many steps of the bound as stay within 1.25."""
    steps = max(1, int(math.log(1.25) / math.log(100 / percent) + 1e-9))
    out, low = [], 1
    while not out or out[-1][1] < largest:
        high = max(low, int(low * (100 / percent) ** steps))
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return tuple(out)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 64-bit hash of every distinct shingle, sorted by both. A shorter text has its whole sequence as one."""
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for first, _, data, bounds in text_pieces(texts):
        start, _, h = word_hashes(_LOWER[data])
        at = np.searchsorted(start, bounds)
        n = np.diff(at)
        grams = np.full(len(h), 0x9E37, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words):
                grams[:len(h) - k] = (grams[:len(h) - k] ^ h[k:]) * np.uint64(0xC6A4A7935BD1E995) + np.uint64(k)
        doc = np.repeat(np.arange(len(n)), n)
        full = np.arange(len(h)) + words <= at[doc + 1]
        short = [(i, _whole(h[at[i]:at[i + 1]])) for i in np.flatnonzero((n > 0) & (n < words))]
        doc, h = np.concatenate([doc[full], np.array([i for i, _ in short], np.int64)]), np.concatenate([mix(grams[full]), np.array([x for _, x in short], np.uint64)])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        docs.append(doc[new] + first)
        hashes.append(h[new])
    return np.concatenate(docs), np.concatenate(hashes)


def _whole(words: np.ndarray) -> int:
    value = len(words)
    for w in words.tolist():
        value = (value * 0x9E3779B97F4A7C15 ^ w) * 0xD1B54A32D192ED03 % (1 << 64)
    return value


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the runs between ``cuts``."""
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return total[cuts[1:]] - total[cuts[:-1]]


def signatures(h: np.ndarray, cuts: np.ndarray, percent: int, dealings: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Set index and signature of 48 bits, for the sets of shingle hashes between ``cuts``, in order of the sets within a run, band and dealing.

    Sets that admit no difference have none. After ``dealings`` tries a set keeps its signatures without features too.
    """
    out_set, out_signature = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    first = 0
    while first < len(cuts) - 1:
        to = max(first + 1, int(np.searchsorted(cuts, cuts[first] + _RUN, "right")) - 1)
        for sets, found in _run_signatures(h[cuts[first]:cuts[to]], cuts[first:to + 1] - cuts[first], percent, dealings):
            out_set.append((sets + first).astype(np.int32))
            out_signature.append(found & _BITS)
        first = to
    return np.concatenate(out_set), np.concatenate(out_signature)


def _run_signatures(h: np.ndarray, cuts: np.ndarray, percent: int, dealings: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for one run of sets, by band and dealing."""
    sizes = np.diff(cuts)
    table = np.array(bands(percent, int(sizes.max(initial=1)) * 100 // percent + 1))
    own = np.searchsorted(table[:, 1], sizes)
    for step in range(len(table)):  # a set also meets the larger sets of the bands above
        band = np.minimum(own + step, len(table) - 1)
        chosen = np.flatnonzero((own + step < len(table)) & (100 * sizes >= percent * table[band, 0]))
        if not len(chosen):
            break
        chosen = chosen[table[band[chosen], 2] > 0]
        for dealing in range(dealings):
            if not len(chosen):
                break
            sets, found, again = _deal(h, cuts, chosen, band[chosen], table[band[chosen], 2], dealing, dealing == dealings - 1)
            yield sets, found
            chosen = again


def _deal(h: np.ndarray, cuts: np.ndarray, chosen: np.ndarray, band: np.ndarray, k: np.ndarray, dealing: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One dealing of the ``chosen`` sets: set index and signature of those with features, and the sets to deal again."""
    sizes = np.diff(cuts)[chosen]
    spare = 1 + (k // 2 + 1) // 8
    parts = k // 2 + 1 + spare
    first_cell = np.concatenate(([0], np.cumsum(parts * _PARTS)))
    ends = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(chosen)), sizes)
    feature = np.repeat(cuts[:-1][chosen], sizes) + np.arange(len(rows)) - np.repeat(ends - sizes, sizes)
    own = h[feature]
    cell = (mix(own ^ mix(np.full(1, dealing + 1, np.uint64))) >> np.uint64(16)) % (parts[rows] * _PARTS).astype(np.uint64)
    cell = first_cell[rows] + cell.astype(np.int64)
    count = np.bincount(cell, minlength=first_cell[-1]).reshape(-1, _PARTS)
    # Halves of 32 bits add up exactly in doubles.
    low = np.bincount(cell, (own & np.uint64(0xFFFFFFFF)).astype(float), first_cell[-1]).astype(np.uint64)
    high = np.bincount(cell, (own >> np.uint64(32)).astype(float), first_cell[-1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        sums = (low + (high << np.uint64(32))).reshape(-1, _PARTS)
        left = sums.sum(1, keepdims=True, dtype=np.uint64) - sums
        part = np.arange(len(sums)) - np.repeat(first_cell[:-1] // _PARTS, parts)
        tag = ((np.repeat(band, parts) * 64 + dealing) * (1 << 24) + part)[:, None] * _PARTS + np.arange(_PARTS)
        found = mix(left + mix(tag.astype(np.uint64) + np.uint64(1)))
    bare = count.sum(1, keepdims=True) == count
    of_set = np.repeat(np.arange(len(chosen)), parts)
    again = np.bincount(of_set, bare.any(1), len(chosen)) > spare
    keep = ~bare | (last & again[of_set])[:, None]
    return np.repeat(chosen[of_set], _PARTS)[keep.ravel()], found.ravel()[keep.ravel()], chosen[again]


_SETS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32())])
_SIGNED = pa.schema([("bucket", pa.int64()), ("home", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32())])
_ARRAYS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _scan(words: int, percent: int, what: str, block_rows: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        for piece, table in enumerate(in_pieces(batches, block_rows)):
            texts = utf8(table["text"].combine_chunks())
            doc, h = shingle_sets(texts, words)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            n = np.diff(cuts)
            k1, k2 = _sums(mix(h), cuts).view(np.int64), _sums(mix(h ^ np.uint64(0xA5A5A5A5)), cuts).astype(np.uint32).view(np.int32)
            if what == "sets":
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), base + piece)), table["doc_id"].combine_chunks(),
                                                  table["fp"].combine_chunks(), pa.array(n),
                                                  pa.array(k1), pa.array(k2)], schema=_SETS)
                continue
            if what == "arrays":  # of rows whose set is that of the class they were joined with
                right = (k1 == long_array(table["want1"].combine_chunks())) & (k2 == table["want2"].to_numpy())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[right]))).astype(np.int32)), pa.array(h[right[doc]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([table["node"].combine_chunks().filter(pa.array(right)), lists], schema=_ARRAYS)
                continue
            order = np.lexsort((k2, k1))
            new = np.ones(len(order), bool)
            new[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            single = np.sort(order[new & (n[order] > 0)])
            keep = np.isin(doc, single)
            at, signature = signatures(h[keep], np.concatenate(([0], np.cumsum(n[single]))), percent)
            by_set = np.argsort(at, kind="stable")  # a class's rows stay together, so its key packs well
            at, signature = single[at[by_set]], signature[by_set]
            del doc, h, keep, by_set
            # A crowd inside this block is a bucket of its own; only its first class goes on to the bucket of all blocks.
            order = np.argsort(signature, kind="stable")
            heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), signature[order][1:] != signature[order][:-1])))
            sizes = np.diff(np.append(heads, len(order)))
            crowded = np.zeros(len(order), bool)
            crowded[order] = np.repeat(sizes >= crowd, sizes)
            with np.errstate(over="ignore"):
                local = mix(signature + mix(np.full(1, base + piece + 1, np.uint64))) & _BITS
            heads = np.sort(order[heads[sizes >= crowd]])
            bucket = np.concatenate([np.where(crowded, local, signature), signature[heads]]).view(np.int64)
            home = pa.array(np.concatenate([signature, signature[heads]]).view(np.int64), mask=~np.concatenate([crowded, np.zeros(len(heads), bool)]))
            rows = np.concatenate([at, at[heads]])
            for a in range(0, len(rows), 200_000):
                b = a + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b]), home[a:b], pa.array(k1[rows[a:b]]), pa.array(k2[rows[a:b]])], schema=_SIGNED)

    return run


_EDGES = "a long, b long"


def connect(values: np.ndarray, cuts: np.ndarray, allowed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect the sets between ``cuts`` as their links do, among the ``allowed`` pairs (a symmetric matrix)."""
    sizes = np.diff(cuts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, feature, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count > 1  # a feature of one set is in no intersection
    row, feature = row[often[feature]], (np.cumsum(often) - 1)[feature[often[feature]]]
    order = np.argsort(feature, kind="stable")
    row, feature = row[order], feature[order]
    shared = np.zeros((len(sizes), len(sizes)))
    for low in range(0, int(often.sum()), 4096):
        part = slice(*np.searchsorted(feature, (low, low + 4096)))
        has = np.zeros((len(sizes), 4096), np.float32)
        has[row[part], feature[part] - low] = 1
        shared += has @ has.T
    linked = allowed & (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared))
    out, left = [], np.ones(len(sizes), bool)
    for start in range(len(sizes)):
        reach = [start] if left[start] else []
        left[start] = False
        while reach:
            new = np.flatnonzero(linked[reach.pop()] & left)
            left[new] = False
            out += [(start, int(x)) for x in new]
            reach += new.tolist()
    return out


def _edges(percent: int):
    """Edges between the classes of one task: rows of different ``side`` only, where there are two, and of different ``root``."""
    def run(table: pa.Table) -> pa.Table:
        node, side, root = (table[c].to_numpy() for c in ("node", "side", "root"))
        lists = table["shingles"].combine_chunks()
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        values, cuts = values[cuts[0]:cuts[-1]], cuts - cuts[0]
        allowed = root[:, None] != root[None, :]
        if side.any():
            allowed &= side[:, None] != side[None, :]
        edges = np.array(connect(values, cuts, allowed, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    return run


def _pieces(rows: str, features: str, block_classes: int, block_features: int):
    """Number of blocks for so many classes with so many features."""
    return F.greatest(F.ceil(F.col(rows) / block_classes), F.ceil(F.col(features) / block_features)).cast("long")


def _later(members: DataFrame, roots: DataFrame, arrays: DataFrame, percent: int, block_classes: int, block_features: int) -> DataFrame:
    """Edges between classes of one cluster (leader, node, n) that are not yet of one component, by pairs of blocks."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("leader")
    placed = cut_lineage(placed.join(open_, "leader", "left_semi"))
    counted = placed.groupBy("leader", "root").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    counted = counted.withColumn("own", _pieces("size", "weight", block_classes, block_features))
    # A component that fills blocks of its own has them to itself; the smaller ones of a cluster share blocks.
    shares = counted.filter("own = 1").groupBy("leader").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    shares = shares.select("leader", _pieces("size", "weight", block_classes, block_features).alias("shares"))
    solo = F.when(F.col("own") > 1, F.col("root"))
    block = F.when(F.col("own") > 1, F.xxhash64("root", F.pmod(F.xxhash64("node"), "own"))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("root"), "shares")))
    placed = cut_lineage(placed.join(counted.select("leader", "root", "own"), ["leader", "root"]).join(shares, "leader", "left")
                         .select("leader", "node", "root", solo.alias("solo"), block.alias("block")))
    blocks = cut_lineage(placed.groupBy("leader", "block").agg(F.max("solo").alias("solo")))
    one, two = (blocks.select("leader", F.col("block").alias(f"block{i}"), F.col("solo").alias(f"solo{i}")) for i in (1, 2))
    tasks = cut_lineage(one.join(two, "leader").filter("block1 <= block2 AND coalesce(solo1 != solo2, true)").select("leader", "block1", "block2"))
    left = placed.join(tasks.withColumn("block", F.col("block1")), ["leader", "block"]).withColumn("side", F.lit(0))
    right = placed.join(tasks.filter("block1 < block2").withColumn("block", F.col("block2")), ["leader", "block"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).join(arrays, "node").select("leader", "block1", "block2", "node", "root", "side", "shingles")
    return both.groupBy("leader", "block1", "block2").applyInArrow(_edges(percent), _EDGES)


def similar_groups(docs: DataFrame, words: int = 3, percent: int = 90, block_rows: int = 20_000, crowd: int = 64,
                   block_classes: int = 512, block_features: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, n_shingles, component_id, first.

    A set holds the distinct runs of ``words`` words, A-Z lower-cased; a shorter text has its whole sequence as one, a text
    without words (null too) has none and links with nothing. Sets link when 100 * shared >= ``percent`` * union.
    ``component_id`` is the smallest doc_id reachable; null ids are rows like any other and give way to known ones; equal
    rows are linked. ``first`` marks, in each component, one row that stands for it: one that holds component_id.
    ``block_rows``, and 8 MB of text, bound what a task holds at once; ``crowd`` is the size from which a block settles a bucket by itself.
    ``block_classes`` and ``block_features`` bound, on average, the sets that one task compares.
    Shingles are compared by 64-bit hashes, classes by 96 bits.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("fp", F.xxhash64("text"))
    scan = lambda what, source, schema: source.mapInArrow(_scan(words, percent, what, block_rows, crowd), schema)
    sets = cut_lineage(scan("sets", text, "block long, doc_id long, fp long, n long, k1 long, k2 int"))
    classes = cut_lineage(sets.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first_id"))
                          .withColumn("node", F.monotonically_increasing_id()))

    signed = scan("signatures", text, "bucket long, home long, k1 long, k2 int")
    spot = Window.partitionBy("bucket")
    # Most signatures are met by one class only; those leave before rows are told apart.
    shared = (signed.repartition("bucket").withColumns({f"{f.__name__}_{k}": f(k).over(spot) for k in ("k1", "k2") for f in (F.min, F.max)})
              .filter("min_k1 != max_k1 OR min_k2 != max_k2").dropDuplicates(["bucket", "k1", "k2"])
              .select(F.coalesce("home", "bucket").alias("home"), "k1", "k2"))
    shared = cut_lineage(shared)
    buckets = cut_lineage(shared.join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("home", "node").distinct())
    drop_cut(shared)
    # The class that meets most others leads its buckets: in a group of near copies, one close to them all.
    sizes = cut_lineage(buckets.groupBy("home").agg(F.count("*").alias("size")))
    degrees = cut_lineage(buckets.join(sizes, "home").groupBy("node").agg(F.sum("size").alias("degree")))
    leads = cut_lineage(buckets.join(degrees, "node").groupBy("home").agg(F.max(F.struct("degree", "node"))["node"].alias("leader")))
    star = cut_lineage(buckets.join(leads, "home").select("leader", "node").distinct().join(classes.select("node", "n"), "node"))
    for spent in (sizes, degrees, leads, buckets):
        drop_cut(spent)

    involved = classes.join(star.select("node").distinct(), "node", "left_semi").select("node", "k1", "k2", "first_id")
    wanted = involved.select("node", F.col("k1").alias("want1"), F.col("k2").alias("want2"), F.col("first_id").alias("wanted"))
    chosen = text.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "node", "want1", "want2")
    arrays = cut_lineage(scan("arrays", chosen, "node long, shingles array<bigint>"))
    if not arrays.groupBy("node").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        arrays = cut_lineage(arrays.dropDuplicates(["node"]))

    held = star.groupBy("leader").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    held = cut_lineage(held.select("leader", _pieces("size", "weight", block_classes, block_features).alias("blocks")))
    own = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "blocks")))
    first = star.join(held, "leader").select("leader", "node", F.explode(own).alias("block"))
    first = first.join(arrays, "node").select("leader", "block", "node", F.col("node").alias("root"), F.lit(0).alias("side"), "shingles")
    links = cut_lineage(first.groupBy("leader", "block").applyInArrow(_edges(percent), _EDGES))
    roots = cut_lineage(components(links))
    # The leader has met all; classes in one block have met each other.
    apart = cut_lineage(star.filter("node != leader").join(held.filter("blocks > 1"), "leader", "left_semi"))
    if not apart.isEmpty():
        fresh = cut_lineage(_later(apart, roots, arrays, percent, block_classes, block_features))
        if not fresh.isEmpty():
            roots = cut_lineage(components(links.unionByName(fresh)))

    grouped = classes.join(roots, "node", "left").select("k1", "k2", "n", "first_id", F.coalesce("root", "node").alias("root"))
    grouped = cut_lineage(grouped)
    ids = cut_lineage(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut_lineage(grouped.join(ids, "root").select("k1", "k2", "n", "root", "component_id"))
    per_block = cut_lineage(sets.filter("n > 0").groupBy("block", "k1", "k2", "n").agg(F.min("doc_id").alias("least_id")).join(named, ["k1", "k2", "n"]))
    # One row stands for a component: in the first block that holds its id.
    holds = F.col("least_id").eqNullSafe(F.col("component_id"))
    holder = per_block.filter(holds).groupBy("root").agg(F.min(F.struct("block", "k1", "k2")).alias("stand"))
    answers = per_block.join(holder, "root").select("block", "k1", "k2", "n", "component_id", (
        F.col("stand") == F.struct("block", "k1", "k2")).alias("stands"))
    return (sets.join(answers, ["block", "k1", "k2", "n"], "left")
            .select("doc_id", "fp", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.when(F.col("n") > 0, F.col("stands") & F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("first")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, **options: int) -> DataFrame:
    """The rows of ``docs`` with one document of each group left, the one with the smallest doc_id; all columns stay.

    Documents without words all stay. Rows that repeat both the id and the text of the one that stays are left alone; exact
    dedup removes them.
    """
    gone = cut_lineage(similar_groups(docs, words, percent, **options).filter(~F.col("first") & ~F.col("doc_id").eqNullSafe(F.col("component_id")))
                       .select(F.col("doc_id").alias("gone_id"), F.col("fp").alias("gone_fp")).distinct())
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("fp"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("fp") == F.col("gone_fp"))
    return keyed.join(gone, same, "left_anti").select("row.*")
