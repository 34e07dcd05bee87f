"""Counters, quotas and sessions: batch twins of the streaming operators, and streams run to their end (inventory 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolake.operators.relational import first_per
from cartolake.plans.registry import query
from cartolake.sources.tables import Tables
from cartolake.streaming import counters, expiring


@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS calls FROM events GROUP BY 1, 2")
def st_rate_minute(t: Tables) -> DataFrame:
    return counters.per_window(t.events, "1 minute").select(F.col("starts").alias("minute"), "user_id", "calls")


@query("SELECT CAST(ts + INTERVAL 3 HOUR AS DATE) AS day, user_id, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def st_quota_day(t: Tables) -> DataFrame:
    """Calls per user and local day over the quota; Istanbul's midnight is 21:00 UTC."""
    day = counters.per_window(t.events, "1 day", offset="21 hours").where("calls > 2")
    return day.select(F.to_date(F.col("starts") + F.expr("INTERVAL 3 HOURS")).alias("day"), "user_id", "calls")


@query("SELECT date_trunc('month', ts)::DATE AS month, count(*) AS calls, count(*) >= 4500 AS spent FROM events GROUP BY 1")
def st_budget_day_month(t: Tables) -> DataFrame:
    return t.events.groupBy(F.trunc(F.to_date("ts"), "MM").alias("month")).agg(F.count("*").alias("calls"), (F.count("*") >= 4500).alias("spent"))


@query(
    """, f AS (SELECT *, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS round FROM usage)
    SELECT user_id, round, count(*) AS failures, min(created_at) AS since FROM f WHERE NOT ok GROUP BY user_id, round HAVING count(*) >= 2""",
    "usage",
)
def st_login_lock(t: Tables) -> DataFrame:
    """Runs of failures since the last success, per key; two or more lock it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = t.usage.withColumn("round", F.sum(F.col("ok").cast("int")).over(w)).where("NOT ok")
    return runs.groupBy("user_id", "round").agg(F.count("*").alias("failures"), F.min("created_at").alias("since")).where("failures >= 2")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS uploads, count(*) FILTER (event_type = 'view') AS proofs FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2")
def st_photo_quota(t: Tables) -> DataFrame:
    return t.events.where("event_type IN ('view', 'click')").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("uploads"), F.count_if(F.col("event_type") == "view").alias("proofs"))


@query(
    """, f AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 12 HOUR AS ends, count(*) AS uses FROM g GROUP BY user_id, s""",
    "usage",
)
def st_session_idle(t: Tables) -> DataFrame:
    return counters.sessions(t.events, "12 hours")


@query("SELECT a.event_id FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND a.event_type = 'error' AND a.ts > b.ts + INTERVAL 60 SECOND)")
def st_token_reuse(t: Tables) -> DataFrame:
    """Uses of a key later than a minute after it was first replaced."""
    first = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("replaced"))
    return t.events.where("event_type = 'error'").join(first, "user_id").where(F.col("ts") > F.col("replaced") + F.expr("INTERVAL 60 SECONDS")).select("event_id")


@query("SELECT report_id FROM reports WHERE NOT resolved AND created_at < TIMESTAMP '2024-01-10' ORDER BY created_at, report_id LIMIT 50", "reports")
def st_pending_retry(t: Tables) -> DataFrame:
    return t.reports.where("NOT resolved AND created_at < '2024-01-10'").orderBy("created_at", "report_id").limit(50).select("report_id")


@query("SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS calls, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def st_stream_windows(t: Tables) -> DataFrame:
    """Hourly counts by a stream over the events, run until all are read."""
    return counters.stream_hourly(t.spark, t.sf_dir)


@query("SELECT route_id, CASE WHEN day < DATE '1996-01-01' THEN 'EXPIRED' ELSE status END AS status FROM routes WHERE status <> 'DONE'", "routes")
def st_scheduled(t: Tables) -> DataFrame:
    """What the nightly expiry job leaves behind."""
    return t.routes.where("status <> 'DONE'").select("route_id", F.when(F.col("day") < F.lit("1996-01-01").cast("date"), "EXPIRED").otherwise(F.col("status")).alias("status"))


@query("SELECT date_trunc('minute', ts) AS starts, user_id, count(*) AS calls FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def st_over_limit(t: Tables) -> DataFrame:
    """Keys over their limit by minute, by a stream run until all events are read."""
    return counters.stream_over_limit(t.spark, t.sf_dir, 1)


@query(
    "SELECT 'user' AS kind, user_id AS id FROM users WHERE balance < 0 AND user_id NOT IN (SELECT user_id FROM usage WHERE user_id IS NOT NULL) UNION ALL SELECT 'code', event_id FROM usage WHERE kind = 'signup' AND (created_at < TIMESTAMP '2024-01-20' OR ok AND cost > 50) UNION ALL SELECT 'session', user_id FROM usage GROUP BY user_id HAVING max(created_at) < TIMESTAMP '2024-01-29'",
    "users usage",
)
def st_retention(t: Tables) -> DataFrame:
    """What a nightly clean-up removes: users who never confirmed, codes used or run out, sessions idle for a day."""
    users = t.users.where("balance < 0").join(t.usage, "user_id", "left_anti").select(F.lit("user").alias("kind"), F.col("user_id").alias("id"))
    codes = t.usage.where("kind = 'signup' AND (created_at < TIMESTAMP_NTZ '2024-01-20' OR ok AND cost > 50)").select(F.lit("code").alias("kind"), F.col("event_id").alias("id"))
    idle = t.usage.groupBy("user_id").agg(F.max("created_at").alias("last")).where("last < TIMESTAMP_NTZ '2024-01-29'")
    return users.unionByName(codes).unionByName(idle.select(F.lit("session").alias("kind"), F.col("user_id").alias("id")))


#: Reads of a cache by user, and what empties a user's entry.
READS, EVICTS = "event_type IN ('view', 'click')", "event_type = 'purchase'"
DAY = 86_400_000_000
#: Row by row: an entry is filled by the first read without one, for four days from then on, unless it is evicted before.
CACHED = f"""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, {EVICTS} AS evicts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {READS} OR {EVICTS}),
    c AS (SELECT event_id, user_id, n, evicts, FALSE AS live, CASE WHEN NOT evicts THEN ts END AS filled, 0 AS hits FROM o WHERE n = 1
    UNION ALL SELECT o.event_id, o.user_id, o.n, o.evicts, coalesce(o.ts < c.filled + INTERVAL 4 DAY, FALSE), CASE WHEN o.evicts THEN NULL WHEN o.ts < c.filled + INTERVAL 4 DAY THEN c.filled ELSE o.ts END,
      CASE WHEN coalesce(o.ts < c.filled + INTERVAL 4 DAY, FALSE) THEN c.hits + CASE WHEN o.evicts THEN 0 ELSE 1 END ELSE 0 END FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1)"""


@query(CACHED + " SELECT event_id, user_id, live AS hit FROM c WHERE NOT evicts")
def st_ttl_cache(t: Tables) -> DataFrame:
    """Of every read whether it hit: a stream with one expiring value by user, emptied by purchases."""
    found = expiring.over_events(t.spark, t.sf_dir, expiring.Cache(4 * DAY), f"{READS} OR {EVICTS}", EVICTS)
    return found.where("NOT evicts").select("event_id", "user_id", F.col("live").alias("hit"))


@query(CACHED + " SELECT event_id, user_id, live AS evicted, CAST(hits AS BIGINT) AS served FROM c WHERE evicts")
def st_events(t: Tables) -> DataFrame:
    """Of every evicting event whether there was a live value, and the hits that it had served."""
    found = expiring.over_events(t.spark, t.sf_dir, expiring.Cache(4 * DAY), f"{READS} OR {EVICTS}", EVICTS)
    return found.where("evicts").select("event_id", "user_id", F.col("live").alias("evicted"), F.col("hits").alias("served"))


@query(
    """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('signup', 'error', 'click')),
    c AS (SELECT event_id, user_id, n, CASE WHEN NOT ok THEN ts END AS since, CASE WHEN ok THEN 0 ELSE 1 END AS failures FROM o WHERE n = 1
    UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN o.ok THEN NULL WHEN o.ts < c.since + INTERVAL 10 DAY THEN c.since ELSE o.ts END, CASE WHEN o.ok THEN 0 WHEN o.ts < c.since + INTERVAL 10 DAY THEN c.failures + 1 ELSE 1 END FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1)
    SELECT event_id, user_id, since, since + INTERVAL 10 DAY AS until FROM c WHERE failures = 3"""
)
def st_login_window(t: Tables) -> DataFrame:
    """Keys that reach three failures within ten days of the first, by a stream; a success, or the window's end, starts anew."""
    found = expiring.over_events(t.spark, t.sf_dir, expiring.Attempts(10 * DAY, 3), "event_type IN ('signup', 'error', 'click')", "event_type = 'signup'")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return found.select("event_id", "user_id", at("since"), at("until"))


@query("SELECT a.event_id, min(b.ts) AS replaced FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'signup' AND a.event_type = 'error' GROUP BY a.event_id, a.ts HAVING a.ts > min(b.ts) + INTERVAL 60 SECOND")
def st_token_replay(t: Tables) -> DataFrame:
    """Uses later than a minute after the first replacement, by a stream that remembers it for 60 days."""
    found = expiring.over_events(t.spark, t.sf_dir, expiring.Replaced(60 * DAY, 60_000_000), "event_type IN ('signup', 'error')", "event_type = 'signup'")
    return found.select("event_id", F.timestamp_micros("replaced").cast("timestamp_ntz").alias("replaced"))
