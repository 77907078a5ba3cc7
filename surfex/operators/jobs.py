"""Job events and resource samples, batch side. The stream operators reuse these functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.content import resource_failure, stage_label
from ..session import cut_lineage

EVENT_SCHEMA = T.StructType([
    T.StructField("protocolVersion", T.IntegerType()), T.StructField("jobID", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("elapsedSeconds", T.DoubleType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("completed", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("photo", T.StringType()),
    T.StructField("message", T.StringType())])

# Events that move the stage, and final statuses.
STAGE_EVENTS = ("stage-started", "stage-reused", "progress")
FINAL_EVENTS = ("completed", "failed", "cancelled")
# Model sizes of the first attempt and of the only retry.
MODEL_SIZES = (518, 392)


def parse_events(lines: DataFrame) -> DataFrame:
    """One row per text line: parsed fields, or ``diagnostic`` holding the line when it is no protocol-1 event."""
    e = F.from_json("value", EVENT_SCHEMA)
    good = F.coalesce((F.col("_e.protocolVersion") == 1) & F.col("_e.event").isNotNull(), F.lit(False))
    return lines.where("value <> ''").withColumn("_e", e).select(
        F.when(good, F.col("_e.jobID")).alias("job_id"), F.when(good, F.col("_e.event")).alias("event"),
        F.when(good, F.col("_e.stage")).alias("stage"), F.when(good, F.col("_e.elapsedSeconds")).alias("elapsed_seconds"),
        F.when(good, F.col("_e.timestamp")).alias("ts"), F.when(good, F.col("_e.completed")).alias("completed"),
        F.when(good, F.col("_e.total")).alias("total"), F.when(good, F.col("_e.message")).alias("message"),
        F.when(~good, F.col("value")).alias("diagnostic"))


def job_state(events: DataFrame) -> DataFrame:
    """Status and stage per job. The first final event fixes the status; the stage is that of the last stage event before it.

    Both are pre-aggregated extremes. The events meet their job's end in a join, which adaptive execution splits where a
    job has most events: the ends are a written table.
    """
    order = F.struct("ts", "event_id")
    end = events.groupBy("job_id").agg(F.min(F.when(F.col("event").isin(*FINAL_EVENTS), F.struct(order.alias("at"), "event", "message"))).alias("_end"))
    end = cut_lineage(end)
    before = F.col("_end").isNull() | (order < F.col("_end.at"))
    moves = F.col("event").isin(*STAGE_EVENTS) & before
    return events.join(end, "job_id").groupBy("job_id").agg(
        F.first("_end").alias("_end"), F.max(F.when(moves, F.struct(order.alias("at"), "stage"))).alias("_last")).select(
        "job_id", F.coalesce("_end.event", F.when(F.col("_last").isNotNull(), F.lit("running")), F.lit("starting")).alias("status"),
        F.col("_last.stage").alias("stage"), F.col("_end.message").alias("message"))


def budget_breaches(samples: DataFrame, rss_limit: int, driver_limit: int, second_limit: float = 0.0) -> DataFrame:
    """First sample per job and stage above a memory limit, or above a non-zero time limit."""
    over = (F.col("rss_bytes") > rss_limit) | F.coalesce(F.col("driver_bytes") > driver_limit, F.lit(False))
    if second_limit > 0:
        over = over | (F.col("seconds") > second_limit)
    first = samples.where(over).groupBy("job_id", "stage").agg(F.min(F.struct("ts", "event_id", "seconds", "rss_bytes", "driver_bytes")).alias("_m"))
    return first.select("job_id", "stage", "_m.*")


def stage_stats(samples: DataFrame) -> DataFrame:
    """Elapsed seconds, peak memory and sample count per job and stage."""
    return samples.groupBy("job_id", "stage").agg(F.max("seconds").alias("elapsed"), F.max("rss_bytes").alias("peak_rss"), F.count("*").alias("samples"))


def session_state(events: DataFrame) -> DataFrame:
    """Outcome per job: cancel wins, then a request failure, then a model with processing complete.

    Needs the boolean columns cancelled, request_failed, has_model and processing_complete.
    """
    s = events.groupBy("job_id").agg(*[F.max(c).alias(c) for c in ("cancelled", "request_failed", "has_model", "processing_complete")])
    return s.withColumn("outcome", F.when(F.col("cancelled"), "cancelled").when(F.col("request_failed"), "failed")
                        .when(F.col("processing_complete") & F.col("has_model"), "completed").otherwise("incomplete"))


def next_attempt(states: DataFrame, first_size: int = 518, retry_size: int = 392) -> DataFrame:
    """One retry at the smaller size, only after the first attempt failed for memory.

    Needs job_id, attempt, status, error, message.
    """
    again = (F.col("attempt") == 0) & (F.col("status") != "cancelled") & (F.col("status") != "completed") \
        & resource_failure(F.col("status"), F.col("error"), F.col("message"))
    return states.withColumn("model_size", F.when(F.col("attempt") == 0, first_size).otherwise(retry_size)) \
        .withColumn("next_size", F.when(again, retry_size))


def resource_failed() -> Column:
    """Whether an event row reports a failure for want of memory."""
    return F.coalesce(resource_failure(F.col("event"), F.col("message"), F.col("message")), F.lit(False))


def attempts(events: DataFrame) -> DataFrame:
    """One row per attempt of a job: attempt, model size, outcome, and the size of the next attempt or 0.

    A final event ends an attempt. A first attempt that failed for memory is tried once more at the smaller size; anything
    later is ignored. Both outcomes are pre-aggregated minima, so a job with most events reduces inside every task.
    """
    ends = events.where(F.col("event").isin(*FINAL_EVENTS)).select("job_id", F.struct("ts", "event_id", "event", resource_failed().alias("resource")).alias("e"))
    two = ends.groupBy("job_id").agg(F.min("e").alias("first"))
    later = ends.join(two, "job_id").where(F.col("e") > F.col("first")).groupBy("job_id").agg(F.min("e").alias("second"))
    both = two.join(later, "job_id", "left")
    again = (F.col("first.event") == "failed") & F.col("first.resource")
    rows = F.array(F.struct(F.lit(0).alias("attempt"), F.lit(MODEL_SIZES[0]).alias("model_size"), F.col("first.event").alias("outcome"), F.when(again, MODEL_SIZES[1]).otherwise(0).alias("next_size")),
                   F.when(again & F.col("second").isNotNull(), F.struct(F.lit(1).alias("attempt"), F.lit(MODEL_SIZES[1]).alias("model_size"), F.col("second.event").alias("outcome"), F.lit(0).alias("next_size"))))
    return both.select("job_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def changed_events(events: DataFrame, columns: tuple[str, ...], bucket: str = "hour") -> DataFrame:
    """Drop events whose value columns equal those of the job's previous event.

    Jobs are cut into time buckets: the previous row comes from a window inside the bucket, and for a bucket's first
    row from the last row of the job's former bucket, so a job with most events is spread over its buckets.
    """
    work = events.withColumn("_b", F.date_trunc(bucket, "ts"))
    value = F.struct(*columns)
    inside = Window.partitionBy("job_id", "_b").orderBy("ts", "event_id")
    last = work.groupBy("job_id", "_b").agg(F.max(F.struct("ts", "event_id", value.alias("v"))).alias("_l"))
    former = last.select("job_id", "_b", F.lag("_l.v").over(Window.partitionBy("job_id").orderBy("_b")).alias("_former"))
    marked = work.withColumn("_prev", F.lag(value).over(inside)).join(former, ["job_id", "_b"])
    return marked.where(~F.coalesce("_prev", "_former").eqNullSafe(value)).drop("_b", "_prev", "_former")


def with_labels(events: DataFrame) -> DataFrame:
    return events.withColumn("label", stage_label(F.col("event"), F.col("stage"), F.col("completed"), F.col("total")))


def run_report(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Per job: elapsed, peak memory, final status, number of messages and the newest message."""
    e = events.groupBy("job_id").agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("elapsed"),
        F.max(F.struct("ts", "event_id", "event")).alias("_s"), F.count("message").alias("messages"),
        F.max(F.when(F.col("message").isNotNull(), F.struct("ts", "event_id", "message"))).alias("_m"))
    peak = samples.groupBy("job_id").agg(F.max("rss_bytes").alias("peak_rss"))
    return e.join(peak, "job_id", "left").select("job_id", "elapsed", "peak_rss", F.col("_s.event").alias("status"), "messages", F.col("_m.message").alias("last_message"))


def run_messages(events: DataFrame) -> DataFrame:
    """Messages of every run in order, one row each."""
    return events.where(F.col("message").isNotNull()).select("job_id", "ts", "event_id", "message").orderBy("job_id", "ts", "event_id")
