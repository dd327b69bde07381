"""Queries over limits and task tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.operators.catalogue import shared_dir
from quern.plans.inputs import table
from quern.plans.queries import query
from quern.streaming import limits, store, tasks


@query("""WITH RECURSIVE r AS (SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'key:' || (user_id % 3) ELSE 'ip:' || user_id END AS key, epoch_us(ts) AS us, event_type = 'error' OR value > 95 AS free FROM events),
t AS (SELECT DISTINCT key, us FROM r WHERE NOT free),
w AS (SELECT key, min(us) AS start FROM t GROUP BY 1 UNION ALL SELECT w.key, (SELECT min(us) FROM t WHERE t.key = w.key AND t.us >= w.start + 3600000000) AS start FROM w WHERE w.start IS NOT NULL),
p AS (SELECT r.*, w.start FROM r ASOF JOIN (SELECT * FROM w WHERE start IS NOT NULL) w ON w.key = r.key AND r.us >= w.start WHERE NOT free),
n AS (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY us, event_id) AS n FROM p)
SELECT key, event_id, n <= 4 AS allowed, CASE WHEN n > 4 THEN greatest(1, CAST(ceil((start + 3600000000 - us) / 1000000) AS BIGINT)) END AS retry_after FROM n UNION ALL SELECT key, event_id, true, NULL FROM r WHERE free""")
def rate_limit(spark, sf):
    """Two keys hold two thirds of all requests."""
    e, u = table(spark, sf, "events"), F.col("user_id")
    key = limits.request_key(F.when(u % 3 > 0, (u % 3).cast("string")), u.cast("string"))
    rows = e.select("event_id", "ts", key.alias("key"), F.when(F.col("event_type") == "error", "/health/live").otherwise("/search").alias("path"), F.when(F.col("value") > 95, "secret").alias("token"))
    return limits.limited(rows, "key", "ts", "event_id", 4, 3600, limits.is_exempt(F.col("path"), F.col("token"), "secret"))


@query("""SELECT user_id, event_type, count(*) AS occurrences, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS last_seen_us, arg_max(event_id, (ts, event_id)) AS payload, CASE WHEN user_id % 2 = 0 AND bool_or(event_id % 3 < 2) THEN 'resolved' ELSE 'open' END AS status FROM events GROUP BY 1, 2""")
def task_table(spark, sf):
    """Three batches merged into a stored table, tasks closed before the third, and each batch run twice."""
    key, e = ["user_id", "event_type"], table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = store.Table(spark, f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}")
    for n in range(3):
        if n == 2:
            store.close_tasks(kept, kept.read().where("user_id % 2 = 0"), key)
        for _ in range(2):
            store.merge_batch(kept, tasks.count_tasks(e.where(F.col("event_id") % 3 == n), key, "ts", "event_id"), key, "events", n)
    return kept.read().select(*key, "occurrences", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_seen_at").alias("last_seen_us"), "payload", "status")


@query("SELECT user_id, max(event_id) AS last_event FROM events WHERE event_id % 5 > 0 GROUP BY 1")
def replace_all(spark, sf):
    """A table whose second version replaces the first."""
    e = table(spark, sf, "events")
    kept = store.Table(spark, f"{shared_dir(spark)}/replaced-{uuid.uuid4().hex}")
    for part in (e, e.where("event_id % 5 > 0")):
        kept.replace(part.groupBy("user_id").agg(F.max("event_id").alias("last_event")))
    return kept.read()
