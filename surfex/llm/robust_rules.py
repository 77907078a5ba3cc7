"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each document's counts become a vector of four transformed statistics. For every (language, source) the minimum
covariance determinant is sought by concentration steps over all rows: from medians and median deviations, distances are
taken, the ``share`` of rows nearest the centre gives the next mean and covariance, and so on. A step is one pass that
adds up counts, sums and products per (group, distance bin), so a hot group is reduced inside every task. Documents whose
Mahalanobis distance exceeds the chi-squared limit are outliers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surfex.session import cut_lineage

from .common import text_pieces, utf8, whole_text, word_grams, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviation of each statistic: mean word length (log), symbols, repeated lines, repeated words (log of 1 + per cent of words).
#: Most rows of a group hold no symbols or repeats, so the floor is all their spread: one count in a document of 264 words, the median of
#: sf0.1, for symbols and lines; repeated words, at most 30 per cent here, are an outlier from 20 per cent on. Times sqrt(chi_limit(1e-6)),
#: 5.8, every floor is below its statistic's range, so each can pass the limit alone.
FLOORS = (0.1, 0.32, 0.32, 0.52)
_DIM = len(FLOORS)
_BIN = 16  # distance bins per doubling
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def count_text(texts: list[bytes], window: int = 8) -> np.ndarray:
    """``COUNTS`` of every whole text (UTF-8)."""
    parts = [_count(data, bounds, window) for _, _, data, bounds in text_pieces(texts)]
    return np.concatenate(parts or [np.zeros((0, len(COUNTS)), np.int64)])


def _count(data: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    docs = len(bounds) - 1
    start, end, hashes = word_hashes(data)
    first = np.searchsorted(start, bounds[:-1])
    last = np.append(first[1:], len(start))
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(letters[end] - letters[start])))
    symbols = np.add.reduceat(_SYMBOLS[data].astype(np.int64), bounds[:-1])
    grams = word_grams(hashes, window)
    out = np.zeros((docs, len(COUNTS)), np.int64)
    out[:, 0], out[:, 1], out[:, 2] = last - first, chars[last] - chars[first], symbols
    for i in range(docs):
        seen: set[bytes] = set()
        for line in data[bounds[i]:bounds[i + 1] - 1].tobytes().split(b"\n"):
            if line in seen:
                out[i, 3] += 1
            elif line.split():
                seen.add(line)
        if last[i] - first[i] > window:
            _, place, times = np.unique(grams[first[i]:last[i] - window + 1], return_inverse=True, return_counts=True)
            again = np.flatnonzero(times[place] > 1)
            if len(again):
                edge = np.zeros(last[i] - first[i] + 1, np.int64)
                np.add.at(edge, again, 1)
                np.add.at(edge, again + window, -1)
                out[i, 4] = (np.cumsum(edge) > 0).sum()
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_count`` array<long> in the order of ``COUNTS``, and ``_failed``, the verdict of the fixed limits."""
    counted = F.arrow_udf(lambda t: pa.array(list(count_text(utf8(t))), pa.list_(pa.int64())), "array<bigint>")
    n, repeated = F.col("_count")[0], F.col("_count")[4]
    return docs.withColumn("_count", counted(whole_text())).withColumn("_failed", (n < 20) | (100 * repeated > 30 * n))


def _vector() -> list[Column]:
    c = F.col("_count")
    n = F.greatest(c[0], F.lit(1))  # texts without words fail the fixed limits
    per_cent = lambda k: F.log1p(100.0 * c[k] / n)
    return [F.log(F.greatest(c[1], F.lit(1)) / n), per_cent(2), per_cent(3), per_cent(4)]


def _group() -> Column:
    return F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))


def _distance(centre: str = "mean", inverse: str = "inverse") -> Column:
    gap = [F.col(f"x{j}") - F.col(centre)[j] for j in range(_DIM)]
    return sum(gap[j] * gap[k] * F.col(inverse)[j * _DIM + k] for j in range(_DIM) for k in range(_DIM))


def chi_limit(tail: float, free: int = _DIM) -> float:
    """The value that a chi-squared variable of an even number of degrees of freedom exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if _chi_tail(x, free) > tail else (low, x)
    return low


def _chi_tail(x: float, free: int) -> float:
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(free // 2))


def consistency(share: float) -> float:
    """Factor that makes the covariance of the central ``share`` of a normal sample that of the whole."""
    return share / (1 - _chi_tail(chi_limit(1 - share), _DIM + 2))


def concentrate(bins: pd.DataFrame, share: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and inverse covariance from the sums per distance bin of one group; the last bin counts in part."""
    bins = bins.sort_values("bin")
    n = bins["n"].to_numpy(float)
    wanted = share * n.sum()
    weight = np.clip(wanted - (np.cumsum(n) - n), 0, n) / n
    total = lambda c: float((bins[c] * weight).sum()) / wanted
    mean = np.array([total(f"s{j}") for j in range(_DIM)])
    product = np.zeros((_DIM, _DIM))
    for j in range(_DIM):
        for k in range(j, _DIM):
            product[j, k] = product[k, j] = total(f"p{j}{k}")
    cov = consistency(share) * (product - np.outer(mean, mean)) + np.diag(np.square(FLOORS))
    return int(n.sum()), mean, np.linalg.inv(cov)


def estimate(counted: DataFrame, share: float = 0.75, steps: int = 4, least_rows: int = 60) -> DataFrame:
    """Per group: ``group``, ``mean``, ``inverse``, and ``parts``, the rows' own groups that use it.

    ``counted`` is a cut result of ``with_counts``. Groups of fewer than ``least_rows`` usable rows are estimated together.
    """
    rows = counted.filter(~F.col("_failed")).select(_group().alias("part"), *(x.alias(f"x{j}") for j, x in enumerate(_vector())))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    parts = cut_lineage(sizes.select("part", F.when(F.col("n") >= least_rows, F.col("part")).otherwise(F.lit("small")).alias("group")))
    rows = rows.join(parts, "part")
    middle = rows.groupBy("group").agg(F.array(*(F.percentile_approx(f"x{j}", 0.5, 10_000) for j in range(_DIM))).alias("mean"))
    middle = cut_lineage(middle)
    near = rows.join(middle, "group")
    spread = near.groupBy("group").agg(F.first("mean").alias("mean"), F.array(*(
        F.percentile_approx(F.abs(F.col(f"x{j}") - F.col("mean")[j]), 0.5, 10_000) for j in range(_DIM))).alias("mad"))
    inverse = F.array(*(1 / (F.pow(1.4826 * F.col("mad")[j], F.lit(2)) + FLOORS[j] ** 2) if j == k else F.lit(0.0) for j in range(_DIM) for k in range(_DIM)))
    state = cut_lineage(spread.select("group", "mean", inverse.alias("inverse")))
    sums = [F.count("*").alias("n"), *(F.sum(f"x{j}").alias(f"s{j}") for j in range(_DIM)),
            *(F.sum(F.col(f"x{j}") * F.col(f"x{k}")).alias(f"p{j}{k}") for j in range(_DIM) for k in range(j, _DIM))]

    def step(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        _, mean, inverse = concentrate(bins, share)
        return pd.DataFrame({"group": [key[0]], "mean": [mean], "inverse": [inverse.ravel()]})

    for _ in range(steps):
        place = F.floor(_BIN * F.log2(1 + F.greatest(_distance(), F.lit(0.0))))
        state = cut_lineage(rows.join(state, "group").withColumn("bin", place).groupBy("group", "bin").agg(*sums)
                            .groupBy("group").applyInPandas(step, "group string, mean array<double>, inverse array<double>"))
    return cut_lineage(parts.join(state, "group"))


def judge(counted: DataFrame, estimates: DataFrame, tail: float = 1e-6) -> DataFrame:
    """``counted`` with ``_distance`` (null where the fixed limits failed) and ``_kept``."""
    out = counted.withColumn("part", _group()).withColumns({f"x{j}": x for j, x in enumerate(_vector())})
    out = out.join(estimates, "part", "left").withColumn("_distance", F.when(~F.col("_failed"), _distance()))
    kept = ~F.col("_failed") & F.coalesce(F.col("_distance") <= chi_limit(tail), F.lit(True))
    return out.withColumn("_kept", kept)


def apply_rules(docs: DataFrame, tail: float = 1e-6, **options: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, the five ``COUNTS``, base_failed, distance, kept.

    Base: at least 20 words, and at most 30 per cent of them in windows of eight words that the text holds twice. Null
    counts as empty, which fails. ``tail`` is the chance of a clean normal row to be rejected. Null languages and sources
    are groups of their own; null and repeated ids are rows like any other; an empty table gives an empty result.
    """
    counted = cut_lineage(with_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")).drop("text"))
    judged = judge(counted, estimate(counted, **options), tail)
    return judged.select("doc_id", *(F.col("_count")[k].alias(c) for k, c in enumerate(COUNTS)), F.col("_failed").alias("base_failed"),
                         F.col("_distance").alias("distance"), F.col("_kept").alias("kept"))
