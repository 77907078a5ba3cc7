"""Job events and samples: batch twins of the stream operators."""

import uuid

from pyspark.sql import functions as F

from ..operators import jobs as J
from . import bindings  # noqa: F401
from .geometry import rounded
from .registry import Tables, query
from .text import r6

LINES = """ln AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN concat('Traceback ', event_id) WHEN event_id % 10 = 4 THEN concat('{"protocolVersion": 2, "event": "x", "jobID": "', user_id, '"}')
 ELSE concat('{"protocolVersion": 1, "event": "', event_type, '", "jobID": "', user_id, '", "completed": ', event_id % 7, '}') END AS value FROM events)"""


def _lines(t):
    k = F.col("event_id") % 10
    u, e = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = F.when(k == 3, F.concat(F.lit("Traceback "), e)).when(k == 4, F.concat(F.lit('{"protocolVersion": 2, "event": "x", "jobID": "'), u, F.lit('"}'))) \
        .otherwise(F.concat(F.lit('{"protocolVersion": 1, "event": "'), "event_type", F.lit('", "jobID": "'), u, F.lit('", "completed": '), (F.col("event_id") % 7).cast("string"), F.lit("}")))
    return t.events.select(text.alias("value"))


@query("s9_parse_events", f"WITH {LINES} SELECT job_id, event, completed, diagnostic, count(*) AS n FROM (SELECT CASE WHEN g THEN value->>'jobID' END AS job_id, CASE WHEN g THEN value->>'event' END AS event, CASE WHEN g THEN (value->>'completed')::INT ELSE -1 END AS completed, CASE WHEN NOT g THEN value END AS diagnostic FROM (SELECT value, CASE WHEN value LIKE '{{%' THEN (value->>'protocolVersion') = '1' ELSE false END AS g FROM ln)) GROUP BY ALL")
def _(t):
    return J.parse_events(_lines(t)).na.fill(-1, ["completed"]).groupBy("job_id", "event", "completed", "diagnostic").agg(F.count("*").alias("n"))


STATE = """en AS (SELECT job_id, min({'ts': ts, 'id': event_id, 'event': event, 'message': message}) FILTER (event IN ('completed','failed','cancelled')) AS e FROM job_events GROUP BY 1),
ls AS (SELECT j.job_id, max({'ts': ts, 'id': event_id, 'stage': stage}) FILTER (event IN ('stage-started','stage-reused','progress') AND (e IS NULL OR ts < e.ts OR (ts = e.ts AND event_id < e.id))) AS l, any_value(e) AS e FROM job_events j JOIN en ON j.job_id = en.job_id GROUP BY 1),
st AS (SELECT job_id, coalesce(e.event, CASE WHEN l IS NOT NULL THEN 'running' END, 'starting') AS status, l.stage AS stage, e.message AS message FROM ls)"""


@query("e2_job_state", f"WITH {STATE} SELECT job_id, status, stage, message FROM st")
def _(t):
    return J.job_state(t.job_events)


@query("e3_budget_breaches", "SELECT job_id, stage, event_id, rss_bytes FROM job_samples WHERE rss_bytes > 800000000 OR coalesce(driver_bytes > 1200000000, false) OR seconds > 100 QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) = 1")
def _(t):
    return J.budget_breaches(t.job_samples, 800000000, 1200000000, 100.0).select("job_id", "stage", "event_id", "rss_bytes")


@query("e4_session_state", "SELECT job_id, CASE WHEN max(value) > 300 THEN 'cancelled' WHEN bool_or(message LIKE '%memory%') THEN 'failed' WHEN bool_or(event = 'completed') AND bool_or(stage = 'package') THEN 'completed' ELSE 'incomplete' END AS outcome FROM job_events GROUP BY 1")
def _(t):
    e = t.job_events.select("job_id", (F.col("value") > 300).alias("cancelled"), F.coalesce(F.col("message").contains("memory"), F.lit(False)).alias("request_failed"),
                            F.coalesce(F.col("stage") == "package", F.lit(False)).alias("has_model"), (F.col("event") == "completed").alias("processing_complete"))
    return J.session_state(e).select("job_id", "outcome")


@query("e5_next_attempt", f"WITH {STATE} SELECT job_id, attempt, CASE WHEN attempt = 0 THEN 518 ELSE 392 END AS model_size, CASE WHEN attempt = 0 AND status NOT IN ('completed','cancelled') AND coalesce(contains(message, 'memory budget'), false) THEN 392 ELSE 0 END AS next_size FROM (SELECT *, (job_id::INT % 2) AS attempt FROM st)")
def _(t):
    s = J.job_state(t.job_events).withColumn("attempt", F.col("job_id").cast("int") % 2).withColumn("error", F.lit(None).cast("string"))
    return J.next_attempt(s).select("job_id", "attempt", "model_size", F.coalesce("next_size", F.lit(0)).alias("next_size"))


ATTEMPTS = """fin AS (SELECT job_id, event, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS attempt, event = 'failed' AND coalesce(contains(message, 'memory budget'), false) AS resource FROM job_events WHERE event IN ('completed', 'failed', 'cancelled')),
tries AS (SELECT f.job_id, f.attempt::INT AS attempt, CASE f.attempt WHEN 0 THEN 518 ELSE 392 END AS model_size, f.event AS outcome, CASE WHEN f.attempt = 0 AND f.resource THEN 392 ELSE 0 END AS next_size
 FROM fin f JOIN fin p ON f.job_id = p.job_id AND p.attempt = 0 WHERE f.attempt = 0 OR (f.attempt = 1 AND p.resource))"""


@query("e5_attempts", f"WITH {ATTEMPTS} SELECT * FROM tries")
def _(t):
    return J.attempts(t.job_events)


@query("e5_stream_attempts", f"WITH {ATTEMPTS} SELECT * FROM tries")
def _(t):
    from ..streaming.events import attempt_stream, run_to_table
    return run_to_table(attempt_stream(_live(t).job_events), "append")


@query("e1_write_parsed", f"WITH {LINES} SELECT CASE WHEN event_id % 10 IN (3, 4) THEN 'diagnostic' ELSE 'event' END AS kind, coalesce(CASE WHEN event_id % 10 IN (3, 4) THEN value ELSE value->>'event' END, '') AS content, count(*) AS n FROM ln GROUP BY 1, 2")
def _(t):
    """The live parse into its two tables, read back."""
    from ..session import checkpoint_folder
    from ..streaming.events import write_parsed
    root = f"{checkpoint_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    write_parsed(_lines(_live(t)), f"{root}/events", f"{root}/diagnostics", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    events = t.spark.read.parquet(f"{root}/events").select(F.lit("event").alias("kind"), F.col("event").alias("content"))
    rest = t.spark.read.parquet(f"{root}/diagnostics").select(F.lit("diagnostic").alias("kind"), F.col("diagnostic").alias("content"))
    return events.unionByName(rest).groupBy("kind", "content").agg(F.count("*").alias("n"))


@query("g23_stage_stats", "SELECT job_id, stage, max(seconds) AS elapsed, max(rss_bytes) AS peak_rss, count(*) AS samples FROM job_samples GROUP BY 1, 2")
def _(t):
    return J.stage_stats(t.job_samples)


@query("e6_running_stage_stats", "SELECT job_id, stage, max(seconds) AS elapsed, max(rss_bytes) AS peak_rss, count(*) AS samples FROM job_samples GROUP BY 1, 2")
def _(t):
    from ..streaming.events import run_to_table, stage_stats_stream
    return run_to_table(stage_stats_stream(_sample_stream(t)), "complete")


@query("e1_stream_parse", "SELECT count(*) FILTER (event_id % 10 NOT IN (3, 4)) AS events, count(*) FILTER (event_id % 10 IN (3, 4)) AS diagnostics FROM events")
def _(t):
    from ..streaming.events import parse_stream, run_to_table
    raw = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    parsed = run_to_table(parse_stream(_lines_of(raw)), "append")
    return parsed.agg(F.count_if(F.col("diagnostic").isNull()).alias("events"), F.count_if(F.col("diagnostic").isNotNull()).alias("diagnostics"))


def _lines_of(events):
    class Holder:
        pass
    h = Holder()
    h.events = events
    return _lines(h)


def _live(t):
    """The same bindings over the events read as a stream."""
    live = Tables(t.spark, t.folder)
    live.cache["events"] = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return live


def _sample_stream(t):
    return _live(t).job_samples


@query("e2_stream_job_state", f"WITH {STATE} SELECT job_id, status, stage, message FROM st")
def _(t):
    from ..streaming.events import job_state_stream, latest, run_to_table
    return latest(run_to_table(job_state_stream(_live(t).job_events), "update"), "job_id")


@query("e3_stream_budget_breaches", "SELECT job_id, stage, event_id, rss_bytes FROM job_samples WHERE rss_bytes > 800000000 OR coalesce(driver_bytes > 1200000000, false) OR seconds > 100 QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) = 1")
def _(t):
    from ..streaming.events import budget_breach_stream, run_to_table
    return run_to_table(budget_breach_stream(_sample_stream(t), 800000000, 1200000000, 100.0), "complete").select("job_id", "stage", "event_id", "rss_bytes")


def _session_flags(e):
    return e.select("job_id", "ts", (F.col("value") > 300).alias("cancelled"), F.coalesce(F.col("message").contains("memory"), F.lit(False)).alias("request_failed"),
                    F.coalesce(F.col("stage") == "package", F.lit(False)).alias("has_model"), (F.col("event") == "completed").alias("processing_complete"))


@query("e4_stream_session_state", "SELECT job_id, CASE WHEN max(value) > 300 THEN 'cancelled' WHEN bool_or(message LIKE '%memory%') THEN 'failed' WHEN bool_or(event = 'completed') AND bool_or(stage = 'package') THEN 'completed' ELSE 'incomplete' END AS outcome FROM job_events GROUP BY 1")
def _(t):
    from ..streaming.events import latest, run_to_table, session_state_stream
    return latest(run_to_table(session_state_stream(_session_flags(_live(t).job_events)), "update"), "job_id").select("job_id", "outcome")


@query("w7_changed_events", "SELECT job_id, event_id FROM (SELECT *, lag(event) OVER w AS pe, lag(stage) OVER w AS ps, row_number() OVER w AS rn FROM job_events WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)) WHERE rn = 1 OR pe IS DISTINCT FROM event OR ps IS DISTINCT FROM stage")
def _(t):
    return J.changed_events(t.job_events, ("event", "stage")).select("job_id", "event_id")


@query("g34_run_report", f"""SELECT e.job_id, {r6('e.elapsed','elapsed')}, peak_rss, status, messages, last_message FROM (SELECT job_id, (epoch_us(max(ts))-epoch_us(min(ts)))/1e6 AS elapsed, arg_max(event, {{'t': ts, 'i': event_id}}) AS status, count(message) AS messages, arg_max(message, {{'t': ts, 'i': event_id}}) FILTER (message IS NOT NULL) AS last_message FROM job_events GROUP BY 1) e
 JOIN (SELECT job_id, max(rss_bytes) AS peak_rss FROM job_samples GROUP BY 1) s ON e.job_id = s.job_id""")
def _(t):
    return J.run_report(t.job_events, t.job_samples).withColumn("elapsed", rounded(F.col("elapsed"), "elapsed"))


@query("g34_run_messages", "SELECT job_id, event_id, message FROM job_events WHERE message IS NOT NULL")
def _(t):
    return J.run_messages(t.job_events).select("job_id", "event_id", "message")
