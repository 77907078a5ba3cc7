"""Spelling variants by asymmetric q-chunks.

Of two words one edit apart, the shorter one (of equal lengths, the lesser) contributes two disjoint chunks that cover it,
the other its positional grams. One edit leaves a chunk whole, and that chunk is a gram of the other word within shift
one: the first chunk stands where it stood, the second is moved by the difference of the lengths, none or one. Grams that
stand elsewhere can meet no chunk and are not sent. Chunks meet equal grams in an equi join whose condition verifies the
single edit, so only true pairs leave it. Each word then takes its most frequent near word as form, and pointer doubling
follows the forms to their root.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surfex.session import cut_lineage, drop_cut

from .common import in_pieces, utf8, whole_text

#: Letters of a word, and of a maximal run: A-Z are lower-cased before.
_LETTER = "[a-zÀ-ÿ]"
#: Code points read at once, and words held before a worker hands its counts on.
_PART, _HELD = 1 << 20, 200_000


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about ``_PART`` code points, cut where no run goes on."""
    at, outside = 0, re.compile(f"(?!{_LETTER}).", re.S)
    while at < len(text):
        end = outside.search(text, at + _PART) if len(text) - at > _PART else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def _tally(least: int, modulus: int):
    run = re.compile(f"{_LETTER}{{{least},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for piece in in_pieces(batches, 16_384):
            for doc_id, text in zip(piece["doc_id"].to_pylist(), utf8(piece["text"])):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for part in _parts(text.lower().decode()):  # bytes.lower changes A-Z only
                    for word, n in Counter(run.findall(part)).items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % modulus:
                            h %= len(word)
                            word = word[:h] + word[h + 1:]
                            if len(word) < least:
                                continue
                        held[word] += n
                if len(held) > _HELD:
                    yield batch(held)
                    held = Counter()
        if held:
            yield batch(held)

    return count


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, modulus: int = 199) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that ``docs`` (doc_id, text) hold ``min_count`` times or more.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Where ``modulus`` divides the crc32 h of
    ``<doc_id>:<word>``, the word loses its code point h mod length. A null id counts as empty there, a null text has no
    words; rows that repeat an id or a text count each. A very frequent word is one row per worker's table of counts.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    return (texts.mapInArrow(_tally(min_length, modulus), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of ``words`` (word, n; distinct) exactly one inserted, deleted or replaced code point apart, each once.

    Words of one code point have an empty first chunk and are compared with all words of one and two; leave them out of large tables.
    """
    size = F.char_length("word")
    half = F.floor(size / 2).cast("int")
    chunks = words.select("word", "n", size.alias("size"), F.posexplode(F.array(
        F.substring("word", F.lit(1), half), F.substring("word", half + 1, size))).alias("side", "gram"))

    def grams(shift: int) -> DataFrame:
        """Grams that the chunks of words shorter by ``shift`` can meet."""
        half = F.floor((size - shift) / 2).cast("int")
        return words.select("word", "n", (size - shift).alias("size"), F.posexplode(F.array(
            F.substring("word", F.lit(1), half), F.substring("word", half + 1 + shift, size))).alias("side", "gram"))

    a, b = chunks.alias("a"), grams(0).unionByName(grams(1)).alias("b")
    same = F.char_length("b.word") == F.col("a.size")
    cut = F.floor(F.col("a.size") / 2).cast("int")
    # A pair that shares both chunks is taken at the first.
    first = (F.col("a.side") == 0) | (F.substring("a.word", F.lit(1), cut) != F.substring("b.word", F.lit(1), cut))
    meet = (F.col("a.size") == F.col("b.size")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.gram") == F.col("b.gram"))
    return a.join(b, meet & (~same | (F.col("a.word") < F.col("b.word"))) & first & (F.levenshtein("a.word", "b.word", 1) == 1)).select(
        F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def follow(links: DataFrame) -> DataFrame:
    """(word, root): the last word that each of ``links`` (word, form) leads to. Links have no cycle and one form a word."""
    done = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = done.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(done.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_cut(done)
        done = step
        if done.filter("moved").isEmpty():
            return done.select("word", "root")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n; distinct).

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is ``ratio`` times the word's own n or
    more, else null; ``form_n`` is its n. ``root`` is where forms lead, the word itself without one. ``n_near`` counts near
    words. An empty table gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"))
    both = near_pairs(words).select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))))
    near = cut_lineage(both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
                       .select("word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("n"))).alias("to")))
    roots = follow(near.filter("to IS NOT NULL").select("word", F.col("to.form").alias("form")))
    return (words.join(near.drop("n"), "word", "left").join(roots, "word", "left")
            .select("word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.col("to.n").alias("form_n")))
