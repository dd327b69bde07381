"""Queries over search, task queues, suggestions, patches and evaluation, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators import moderation
from quern.plans.inputs import DEVICES, devices, table
from quern.plans.queries import query
from quern.streaming import tasks

@query("SELECT user_id, event_type, n AS occurrences, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1, 2 HAVING count(*) > 1)) ORDER BY n DESC, seen DESC, user_id, event_type LIMIT 20 OFFSET 20")
def task_page(spark, sf):
    t = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("occurrences"), F.max("ts").alias("seen")).where("occurrences > 1")
    return moderation.page(t, [F.desc("occurrences"), F.desc("seen"), F.asc("user_id"), F.asc("event_type")], 2, 20).select("user_id", "event_type", "occurrences", "total")


@query("SELECT o_orderkey, o_custkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def change_page(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return moderation.page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50).select("o_orderkey", "o_custkey", "total")


SCREENS = "screens AS (SELECT DISTINCT 300 + id % 211 AS w, 600 + (id * 7) % 307 AS h, 1 + (id % 3) * 0.5 AS dpr FROM devices)"


@query(f"""WITH {DEVICES}, {SCREENS}, asked AS (SELECT s_suppkey, 290 + (s_suppkey * 13) % 250 AS w, 580 + (s_suppkey * 29) % 350 AS h, 1 + (s_suppkey % 5) * 0.25 AS dpr FROM supplier),
d AS (SELECT s_suppkey, s.w, s.h, s.dpr, abs(s.w - a.w) + abs(s.h - a.h) + abs(s.dpr - a.dpr) * 100 AS distance FROM asked a, screens s),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, w, h, dpr) AS rank FROM d) SELECT s_suppkey, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(dpr AS DOUBLE) AS dpr, CAST(distance AS DOUBLE) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def geometry_topk(spark, sf):
    n, s = F.col("id"), F.col("s_suppkey")
    screens = devices(spark, sf).select((300 + n % 211).cast("int").alias("w"), (600 + (n * 7) % 307).cast("int").alias("h"), (1 + (n % 3) * F.lit(0.5)).alias("dpr")).distinct()
    asked = table(spark, sf, "supplier").select("s_suppkey", (290 + (s * 13) % 250).cast("int").alias("w"), (580 + (s * 29) % 350).cast("int").alias("h"), (1 + (s % 5) * F.lit(0.25)).alias("dpr"))
    return moderation.nearest_screens(asked, screens, "s_suppkey", 5)


@query(f"""WITH {DEVICES}, p AS (SELECT id, support, confidence, CASE WHEN id % 4 = 0 THEN 'supported' END AS old_support, CASE WHEN id % 5 = 0 THEN 'note ' || id END AS old_note, CASE WHEN id % 3 = 0 THEN 'not_supported' END AS new_support, id % 6 = 0 AS sets_note, CASE WHEN id % 12 = 0 THEN 'new' END AS new_note, CASE WHEN id % 7 < 3 THEN 'u' || (id % 2) END AS url, CASE WHEN id % 6 > 0 THEN ['u0'] ELSE [] END AS urls FROM devices),
m AS (SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN new_support ELSE old_support END, support) AS support, CASE WHEN sets_note THEN new_note ELSE old_note END AS note, CASE WHEN url IS NULL OR list_contains(urls, url) THEN urls ELSE list_append(urls, url) END AS sources, CASE WHEN url IS NOT NULL THEN 'verified' ELSE confidence END AS confidence FROM p)
SELECT id, support, note, array_to_string(sources, '|') AS sources, confidence, CASE WHEN confidence = 'verified' AND len(sources) = 0 THEN 'VALIDATION_ERROR' END AS fault FROM m""")
def patch_merge(spark, sf):
    n = F.col("id")
    d = devices(spark, sf).select("id", "support", "confidence", F.when(n % 6 > 0, F.array(F.lit("u0"))).otherwise(F.array().cast("array<string>")).alias("sources"))
    esim = lambda s, t: F.struct(s.alias("support"), t.alias("note"))
    old = esim(F.when(n % 4 == 0, "supported"), F.when(n % 5 == 0, F.concat(F.lit("note "), n.cast("string"))))
    new = esim(F.when(n % 3 == 0, "not_supported"), F.when(n % 12 == 0, "new"))
    named = F.filter(F.array(F.when(n % 3 == 0, "support"), F.when(n % 6 == 0, "note")), lambda x: x.isNotNull())
    merged = moderation.merged_patch(old, new, named, ["support", "note"])
    url = F.when(n % 7 < 3, F.concat(F.lit("u"), (n % 2).cast("string")))
    sources, sure = moderation.with_source(F.col("sources"), F.col("confidence"), url)
    out = d.select("id", F.coalesce(merged["support"], "support").alias("support"), merged["note"].alias("note"), sources.alias("sources"), sure.alias("confidence"))
    return out.withColumn("fault", moderation.patch_fault(F.col("sources"), F.col("confidence"))).withColumn("sources", F.array_join("sources", "|"))


@query("""WITH e AS (SELECT event_type AS category, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'clarification_required' ELSE 'not_supported' END AS es, CASE user_id % 4 WHEN 0 THEN 'not_supported' WHEN 1 THEN 'clarification_required' ELSE 'supported' END AS gs, event_id % 5 = 0 AS ex, user_id % 5 = 0 OR event_id % 10 = 0 AS gx, CASE WHEN event_id % 2 = 0 THEN 'ios' ELSE 'android' END AS ep, CASE WHEN event_id % 14 < 12 THEN CASE WHEN event_id % 2 = 0 THEN 'ios' ELSE 'android' END ELSE 'other' END AS gp, event_id % 3 AS ed, user_id % 3 AS gd FROM events),
r AS (SELECT *, es = gs AND ep = gp AND ex = gx AND (NOT ex OR ed = gd) AS ok FROM e)
SELECT coalesce(category, 'total') AS category, count(*) AS total, CAST(count_if(ok) AS BIGINT) AS correct, CAST(count_if(gs <> 'clarification_required' AND gs <> es) AS BIGINT) AS false_positive, CAST(count_if(es = 'clarification_required' AND gs = es) AS BIGINT) AS correct_clarifications, CAST(count_if(es <> 'clarification_required' AND gs = 'clarification_required') AS BIGINT) AS excess_clarifications, CAST(count_if(gs <> 'clarification_required') AS BIGINT) AS automatic FROM r GROUP BY ROLLUP (category)""")
def detection_eval(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    phone = F.when(n % 2 == 0, "ios").otherwise("android")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.when(n % 3 == 0, "supported").when(n % 3 == 1, rules.ASK).otherwise("not_supported").alias("expected_status"), F.when(u % 4 == 0, "not_supported").when(u % 4 == 1, rules.ASK).otherwise("supported").alias("given_status"), (n % 5 == 0).alias("expected_exact"), ((u % 5 == 0) | (n % 10 == 0)).alias("given_exact"),
        phone.alias("expected_platform"), F.when(n % 14 < 12, phone).otherwise("other").alias("given_platform"), F.lit("phone").alias("expected_type"), F.lit("phone").alias("given_type"), (n % 3).alias("expected_device"), (u % 3).alias("given_device"),
    )
    return moderation.detection_evaluated(e, "category")


EVAL = """e AS (SELECT event_id, event_type AS category, CASE event_id % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'clarification' WHEN 2 THEN 'not_found' ELSE 'match' END AS expected, CASE WHEN event_id % 4 = 0 THEN user_id % 5 END AS expected_id,
  CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'clarification_required' ELSE 'not_supported' END AS status, CASE WHEN event_id % 5 < 3 THEN user_id % 6 END AS device, event_id % 7 % 3 AS matches, CASE event_id % 11 WHEN 0 THEN 'answer_question' WHEN 1 THEN 'select_model' END AS kind FROM events)"""


@query(f"""WITH {EVAL}, o AS (SELECT *, CASE WHEN status = 'clarification_required' AND matches > 0 THEN 'clarification' WHEN device IS NOT NULL OR status <> 'clarification_required' OR coalesce(kind = 'answer_question', false) THEN 'match' ELSE 'not_found' END AS actual FROM e),
r AS (SELECT *, actual = expected AND (expected_id IS NULL OR coalesce(device = expected_id, false) OR (expected = 'match' AND device IS NULL AND (status <> 'clarification_required' OR coalesce(kind = 'answer_question', false)))) AS correct FROM o)
SELECT coalesce(category, 'total') AS category, count(*) AS total, CAST(count_if(correct) AS BIGINT) AS correct, CAST(count_if(actual = 'match' AND device IS NOT NULL AND NOT correct) AS BIGINT) AS false_positive, CAST(count_if(expected = 'clarification') AS BIGINT) AS expected_clarifications, CAST(count_if(expected = 'clarification' AND actual = 'clarification') AS BIGINT) AS correct_clarifications,
  CAST(count_if(expected = 'match') AS BIGINT) AS expected_matches, CAST(count_if(expected = 'match' AND actual = 'clarification') AS BIGINT) AS excess_clarifications, CAST(count_if(actual = 'match') AS BIGINT) AS automatic FROM r GROUP BY ROLLUP (category)""")
def matching_eval(spark, sf):
    n, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("category"), F.when(n % 4 == 1, "clarification").when(n % 4 == 2, "not_found").otherwise("match").alias("expected"), F.when(n % 4 == 0, u % 5).alias("expected_id"),
        F.when(n % 3 == 0, "supported").when(n % 3 == 1, rules.ASK).otherwise("not_supported").alias("status"), F.when(n % 5 < 3, u % 6).alias("device"), (n % 7 % 3).alias("matches"), F.when(n % 11 == 0, "answer_question").when(n % 11 == 1, "select_model").alias("kind"),
    )
    return moderation.evaluated(e, "category")


@query(f"""WITH {DEVICES}, t AS (SELECT brand, count(*) AS total, CAST(count_if(confidence = 'quarantined') AS BIGINT) AS rejected FROM devices GROUP BY 1) SELECT brand, total, rejected, 5 * rejected > total AS refused FROM t""")
def quarantine_gate(spark, sf):
    t = devices(spark, sf).groupBy("brand").agg(F.count("*").alias("total"), F.count_if(F.col("confidence") == "quarantined").alias("rejected"))
    return t.select("brand", "total", "rejected", moderation.refused(F.col("total") - F.col("rejected"), F.col("rejected")).alias("refused"))


TASKS = """t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'unknown_model_code' WHEN 1 THEN 'unknown_screen_signature' WHEN 2 THEN 'csv_quarantine' WHEN 3 THEN 'source_disagreement' WHEN 4 THEN 'user_feedback' WHEN 5 THEN 'ambiguous_query' ELSE 'unmatched_query' END AS kind,
  CASE user_id % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'link_model_code' WHEN 2 THEN 'confirm_quarantine' WHEN 3 THEN 'acknowledge_feedback' WHEN 4 THEN 'resolve_source_disagreement' ELSE 'link_screen_signature' END AS action FROM events)"""


@query(f"""WITH {TASKS}, r AS (SELECT kind, action, CASE WHEN action = 'reject' THEN 'rejected' WHEN (kind || '+' || action) IN ('unknown_model_code+link_model_code', 'unknown_screen_signature+link_screen_signature', 'csv_quarantine+confirm_quarantine', 'source_disagreement+resolve_source_disagreement', 'user_feedback+acknowledge_feedback', 'ambiguous_query+link_model_code', 'unmatched_query+link_model_code') THEN 'resolved' ELSE 'invalid' END AS outcome FROM t)
SELECT kind, action, outcome, count(*) AS n FROM r GROUP BY ALL""")
def task_transitions(spark, sf):
    kinds = ["unknown_model_code", "unknown_screen_signature", "csv_quarantine", "source_disagreement", "user_feedback", "ambiguous_query", "unmatched_query"]
    actions = ["reject", "link_model_code", "confirm_quarantine", "acknowledge_feedback", "resolve_source_disagreement", "link_screen_signature"]
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    t = table(spark, sf, "events").select(pick(kinds, F.col("event_id")).alias("kind"), pick(actions, F.col("user_id")).alias("action"))
    return t.groupBy("kind", "action", moderation.transition(F.col("kind"), F.col("action")).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT event_id, sha256(props) AS signals_hash, epoch_us(ts) AS created_us FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY AND event_type <> 'click' AND (event_type <> 'view' OR ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)")
def retention_log(spark, sf):
    e = table(spark, sf, "events").where("event_type <> 'click'")
    kept = moderation.retained(e, "ts", F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 20, {"view": 10}, "event_type")
    return kept.select("event_id", F.sha2(F.col("props").cast("binary"), 256).alias("signals_hash"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"))


@query(f"""WITH {DEVICES}, c AS (SELECT unnest(['verified', 'derived', 'unverified', 'quarantined', 'curated']) AS level) SELECT c.level, count(d.id) AS n FROM c LEFT JOIN devices d ON d.confidence = c.level GROUP BY 1""")
def level_counts(spark, sf):
    return moderation.filled_counts(devices(spark, sf), "confidence", ["verified", "derived", "unverified", "quarantined", "curated"], "level")


@query(f"""WITH {DEVICES} SELECT id, CASE support WHEN 'supported' THEN name || ' can use an eSIM' WHEN 'not_supported' THEN name || ' has no eSIM' ELSE 'Which model is it?' END AS title, CASE WHEN support = 'conditional' THEN 'clarify' WHEN id % 2 = 0 OR support = 'not_supported' THEN 'manual_search' ELSE 'clarify' END AS action FROM devices""")
def presentation(spark, sf):
    shown = moderation.presented(F.when(F.col("support") == "conditional", rules.ASK).otherwise(F.col("support")), F.col("name"), F.col("id") % 2 == 0)
    return devices(spark, sf).select("id", shown.alias("p")).select("id", "p.title", "p.action")


@query("""WITH a AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS c, max(ts) AS l, arg_max(event_id, (ts, event_id)) AS p FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS c, max(ts) AS l, arg_max(event_id, (ts, event_id)) AS p FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) + coalesce(b.n, 0) AS occurrences, epoch_us(least(a.c, b.c)) AS created_us, epoch_us(greatest(a.l, b.l)) AS last_seen_us, CASE WHEN a.l IS NULL OR b.l >= a.l THEN b.p ELSE a.p END AS payload,
  CASE WHEN a.n IS NOT NULL AND a.user_id % 2 = 0 THEN 'resolved' ELSE 'open' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""")
def task_merge(spark, sf):
    key, e = ["user_id", "event_type"], table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    count = lambda rows: tasks.count_tasks(rows, key, "ts", "event_id")
    old = count(e.where("event_id % 3 > 0")).withColumn("status", F.when(F.col("user_id") % 2 == 0, "resolved").otherwise("open"))
    out = tasks.merge_tasks(old, count(e.where("event_id % 3 = 0")), key)
    return out.select(*key, "occurrences", F.unix_micros("created_at").alias("created_us"), F.unix_micros("last_seen_at").alias("last_seen_us"), "payload", "status")


@query(f"""WITH {DEVICES} SELECT id, support, CASE WHEN support = 'supported' AND id % 3 = 0 THEN 'VALIDATION_ERROR' END AS code, CASE WHEN id % 4 = 0 THEN 'Nova|' ELSE '' END || lower(brand || ' ' || name) || CASE WHEN id % 4 = 1 THEN '|x' ELSE '' END AS aliases,
CASE support WHEN 'not_supported' THEN 'none' ELSE 'physical+esim' END AS dual_sim, CASE WHEN id % 2 = 0 THEN 0.25 ELSE 0.5 END AS popularity, CASE WHEN id % 3 = 0 THEN 'derived' ELSE 'verified' END AS confidence FROM devices""")
def device_form(spark, sf):
    n = F.col("id")
    d = devices(spark, sf)
    aliases = F.when(n % 4 == 0, F.array(F.lit("Nova"))).when(n % 4 == 1, F.array(F.lower(F.concat_ws(" ", "brand", "name")), F.lit("x")))
    sources = F.when(n % 3 > 0, F.array(F.lit("http://a"))).when(n % 2 == 0, F.array().cast("array<string>"))
    forms = d.select("id", "brand", F.col("brand").alias("brand_title"), F.col("name").alias("marketing_name"), "support", sources.alias("sources"), aliases.alias("aliases"), F.lit(None).cast("string").alias("notes"), F.when(n % 2 == 0, 0.25).alias("popularity"))
    return moderation.device_from_form(forms).select("id", "support", "code", F.array_join("aliases", "|").alias("aliases"), "dual_sim", "popularity", "confidence")
