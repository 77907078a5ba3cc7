"""Row numbers and exact quantiles that never gather a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_index(df: DataFrame, order: list[str], bucket: Column, by: list[str] | None = None,
              name: str = "row_index") -> DataFrame:
    """0-based position of each row within its group, in the given order.

    ``bucket`` must never decrease along ``order``. Rows are numbered inside (group, bucket) and shifted by the
    number of rows in earlier buckets, so a group that holds most rows is still split over its buckets.
    """
    by = by or []
    work = df.withColumn("_bucket", bucket)
    counts = work.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return work.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, [*by, "_bucket"]) \
        .withColumn(name, F.col("_rank") + F.col("_offset")).drop("_rank", "_offset", "_bucket")


def exact_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float],
                    accuracy: int = 10000, salts: int = 64) -> DataFrame:
    """Linear-interpolated quantiles per group.

    A bounded sketch first brackets each quantile (its rank error is at most rows/accuracy). The exact ranks are then
    searched among the distinct values inside the bracket only; rows below it are just counted. So a group of any
    size costs one sketch, one count and a sort of about 20/accuracy of its rows. The brackets meet the values once per
    salt of the value, so a group that holds most rows is dealt over ``salts`` join tasks. Files hold far fewer bytes than the
    values and brackets made of them, so estimates would send either through the driver: that join is merged.
    """
    keys = by or ["_all"]
    base = df.where(F.col(value).isNotNull()) if by else df.where(F.col(value).isNotNull()).withColumn("_all", F.lit(1))
    base = base.select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)))
    slack = 10 / accuracy
    names = list(points)
    ends = [e for n in names for e in (max(0.0, points[n] - slack), min(1.0, points[n] + slack))]
    sketch = base.groupBy(*keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_b"), F.count("*").alias("_n"),
                                     F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    # Below 4/slack rows the bracket could be narrower than the two ranks in question: take the whole small group.
    small = F.col("_n") * slack < 4
    spans = F.array(*[F.struct(F.lit(i).alias("q"), F.when(small, F.col("_least")).otherwise(F.col("_b")[2 * i]).alias("lo"),
                               F.when(small, F.col("_most")).otherwise(F.col("_b")[2 * i + 1]).alias("hi"))
                      for i in range(len(names))])
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    brackets = sketch.select(*keys, "_n", spans.alias("_spans")).withColumn("_salt", every)
    cut = base.join(brackets.hint("merge"), [*keys, "_salt"]) \
        .select(*keys, "_n", "_v", F.explode("_spans").alias("_s")) \
        .where(F.col("_v") <= F.col("_s.hi")) \
        .groupBy(*keys, "_n", F.col("_s.q").alias("_q"), F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v")).alias("_v")) \
        .agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys, "_q").orderBy(F.col("_v").asc_nulls_first())
    cum = cut.withColumn("_cum", F.sum("_c").over(upto))
    share = F.element_at(F.array(*[F.lit(float(points[n])) for n in names]), F.col("_q") + 1)
    ranked = cum.withColumn("_pos", share * (F.col("_n") - 1))
    low = F.min(F.when(F.col("_cum") > F.floor("_pos"), F.col("_v")))
    high = F.min(F.when(F.col("_cum") > F.ceil("_pos"), F.col("_v")))
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    found = ranked.groupBy(*keys, "_q").agg((low + (high - low) * frac).alias("_x"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)])
    return out if by else out.drop("_all")


def exact_quantiles_of(df: DataFrame, by: list[str], specs: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """Quantiles of several value expressions in one pass: {label: (value, {output name: point})}.

    The values are stacked, so the input is read once for all of them; a null value is left out.
    """
    points = sorted({q for _, named in specs.values() for q in named.values()})
    stack = F.array(*[F.struct(F.lit(label).alias("_metric"), value.cast("double").alias("_value")) for label, (value, _) in specs.items()])
    found = exact_quantiles(df.select(*by, F.inline(stack)), [*by, "_metric"], "_value", {f"_q{i}": q for i, q in enumerate(points)})
    outputs = [F.max(F.when(F.col("_metric") == label, F.col(f"_q{points.index(q)}"))).alias(name)
               for label, (_, named) in specs.items() for name, q in named.items()]
    return found.groupBy(*by).agg(*outputs)


def thin_evenly(df: DataFrame, order: list[str], bucket: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """Rows at the integer positions floor(i * (rows-1) / (n-1)), i < n; all rows when there are at most n."""
    by = by or []
    numbered = row_index(df, order, bucket, by)
    total = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    last, k = F.col("_rows") - 1, F.col("row_index")
    first_i = F.floor((k * (n - 1) + last - 1) / F.greatest(last, F.lit(1)))
    hit = (F.col("_rows") <= n) | (F.floor(first_i * last / (n - 1)) == k)
    joined = numbered.join(total, by) if by else numbered.join(total, F.lit(True))
    return joined.where(hit).drop("_rows")


def thin_stride(df: DataFrame, order: list[str], bucket: Column, about: int, by: list[str]) -> DataFrame:
    """Every k-th row with k = max(1, rows div about)."""
    total = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    step = F.greatest(F.lit(1), F.floor(F.col("_rows") / about))
    return row_index(df, order, bucket, by).join(total, by).where(F.col("row_index") % step == 0).drop("_rows")


def probe_rows(df: DataFrame, order: list[str], bucket: Column, by: list[str]) -> DataFrame:
    """First, middle (rows div 2) and last row of each group."""
    total = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    k, n = F.col("row_index"), F.col("_rows")
    return row_index(df, order, bucket, by).join(total, by) \
        .where((k == 0) | (k == F.floor(n / 2)) | (k == n - 1)).drop("_rows")


def holdout_split(df: DataFrame, order: list[str], bucket: Column, by: list[str], every: int = 3) -> DataFrame:
    """Frozen split: in the given order every ``every``-th row, starting with the first, is held out."""
    return row_index(df, order, bucket, by).withColumn("holdout", F.col("row_index") % every == 0)
