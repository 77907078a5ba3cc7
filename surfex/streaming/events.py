"""Event-log streams: parsing with diagnostics, job state, budget breaches, session outcome, running statistics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs
from ..session import checkpoint_folder

parse_stream = jobs.parse_events
stage_stats_stream = jobs.stage_stats


def write_parsed(lines: DataFrame, events_path: str, diagnostics_path: str, checkpoint: str):
    """Start the live parse: events and diagnostics go to two tables, one micro-batch at a time.

    Each batch writes under its own id with overwrite, so a batch repeated after a failure replaces itself; it is parsed once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where("diagnostic IS NULL").drop("diagnostic").write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
        batch.where("diagnostic IS NOT NULL").select("diagnostic").write.mode("overwrite").parquet(f"{diagnostics_path}/batch={batch_id}")
        batch.unpersist()

    return parse_stream(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Expiring(StatefulProcessor):
    """One value per key; ``keep_seconds`` of event time after a key has ended, its value is dropped."""

    def __init__(self, columns: str, keep_seconds: int):
        self.columns, self.keep_ms = columns, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.columns)

    def ended(self, key_time_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(key_time_ms + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _milliseconds(times: pd.Series) -> int:
    return int(times.max().timestamp() * 1000)


class _JobFold(_Expiring):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, stage, message = self.value.get() if self.value.exists() else ("starting", None, None)
        # One micro-batch of one job may come in several unordered pieces; only the few events that matter are kept.
        pieces = [p.loc[p["event"].isin([*jobs.FINAL_EVENTS, *jobs.STAGE_EVENTS]), ["ts", "event_id", "event", "stage", "message"]] for p in rows]
        met = pd.concat(pieces).sort_values(["ts", "event_id"])
        for event, at, text in met[["event", "stage", "message"]].itertuples(index=False, name=None):
            if status in jobs.FINAL_EVENTS:
                break
            if event in jobs.FINAL_EVENTS:
                status, message = event, text
            else:
                status, stage = "running", at
        self.value.update((status, stage, message))
        if status in jobs.FINAL_EVENTS and len(met):
            self.ended(_milliseconds(met["ts"]))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "stage": [stage], "message": [message]})


class _AttemptFold(_Expiring):
    """State: attempts made, whether the job has ended."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        attempts, ended = self.value.get() if self.value.exists() else (0, False)
        met = pd.concat([p.loc[p["event"].isin(jobs.FINAL_EVENTS), ["ts", "event_id", "event", "resource"]] for p in rows]).sort_values(["ts", "event_id"])
        out = []
        for event, resource in met[["event", "resource"]].itertuples(index=False, name=None):
            if ended:
                break
            again = attempts == 0 and event == "failed" and bool(resource)
            out.append((key[0], attempts, jobs.MODEL_SIZES[attempts], event, jobs.MODEL_SIZES[1] if again else 0))
            attempts, ended = attempts + 1, not again
        self.value.update((attempts, ended))
        if ended and len(met):
            self.ended(_milliseconds(met["ts"]))
        yield pd.DataFrame(out, columns=["job_id", "attempt", "model_size", "outcome", "next_size"])


class _FlagFold(_Expiring):
    def __init__(self, names: tuple[str, ...], keep_seconds: int):
        super().__init__(", ".join(f"{n} boolean" for n in names), keep_seconds)
        self.names = names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flags, newest = list(self.value.get()) if self.value.exists() else [False] * len(self.names), 0
        for pdf in rows:
            flags = [bool(f or pdf[n].any()) for f, n in zip(flags, self.names)]
            newest = max(newest, _milliseconds(pdf["ts"]))
        self.value.update(tuple(flags))
        if flags[0] or flags[1] or flags[3]:  # cancelled, failed or processed
            self.ended(newest)
        yield pd.DataFrame({"job_id": [key[0]], **{n: [f] for n, f in zip(self.names, flags)}})


def _folded(rows: DataFrame, fold: StatefulProcessor, out: str, mode: str, lateness: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy("job_id").transformWithStateInPandas(fold, out, mode, "EventTime")


def job_state_stream(events: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 3600) -> DataFrame:
    """Latest status and stage per job; final statuses stay. State is three strings per job.

    A job that has ended leaves the state ``keep_seconds`` of event time later; events that are later than ``lateness`` are
    dropped. Events of a job arrive in order over one pipe, so only the events of one micro-batch are ordered here; the
    source's rate option (for files ``maxFilesPerTrigger``) bounds how many that are.
    """
    return _folded(events, _JobFold("status string, stage string, message string", keep_seconds), "job_id string, status string, stage string, message string", "Update", lateness)


def attempt_stream(events: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 3600) -> DataFrame:
    """One row per attempt of a job as it ends, with the size of the next attempt or 0; the twin of ``jobs.attempts``.

    State is the number of attempts and whether the job has ended; it expires as in ``job_state_stream``.
    """
    marked = events.withColumn("resource", jobs.resource_failed())
    return _folded(marked, _AttemptFold("attempts int, ended boolean", keep_seconds), "job_id string, attempt int, model_size int, outcome string, next_size int", "Append", lateness)


def session_state_stream(events: DataFrame, lateness: str = "10 minutes", keep_seconds: int = 3600) -> DataFrame:
    """Session outcome per job; a model stays provisional until processing completes, cancel and failure win.

    Needs ``ts`` and the four boolean columns. An ended session leaves the state as in ``job_state_stream``.
    """
    names = ("cancelled", "request_failed", "has_model", "processing_complete")
    flags = _folded(events, _FlagFold(names, keep_seconds), f"job_id string, {', '.join(f'{n} boolean' for n in names)}", "Update", lateness)
    return flags.withColumn("outcome", F.when(F.col("cancelled"), "cancelled").when(F.col("request_failed"), "failed")
                            .when(F.col("processing_complete") & F.col("has_model"), "completed").otherwise("incomplete"))


def budget_breach_stream(samples: DataFrame, rss_limit: int, driver_limit: int, second_limit: float = 0.0) -> DataFrame:
    """First breach per job and stage, as a running pre-aggregated minimum."""
    return jobs.budget_breaches(samples, rss_limit, driver_limit, second_limit)


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """Newest row per key of a table written in update mode by ``run_to_table``."""
    rest = [c for c in updates.columns if c not in (*keys, "_batch")]
    best = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_m"))
    return best.select(*keys, "_m.*")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is available now and read its result back from the shared checkpoint folder."""
    root = f"{checkpoint_folder(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/b{batch_id}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    out = stream.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.IntegerType())]) if "_batch" not in schema.names else schema).parquet(f"{root}/out/*")
    if mode == "append":
        return out.drop("_batch")
    newest = out.agg(F.max("_batch").alias("_batch"))
    return out.join(newest, "_batch").drop("_batch") if mode == "complete" else out
