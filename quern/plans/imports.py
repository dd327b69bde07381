"""Queries over guards, reports and pages of the catalogue, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalogue as cat
from quern.operators import reports
from quern.plans.inputs import DEVICES, VOTES, devices, table, votes
from quern.plans.queries import query

#: Devices as they come from an import: support may be unknown; some iOS ones lack screens or a version.
MADE = """made AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'unknown' ELSE support END AS support, confidence, CASE WHEN id % 3 = 0 THEN 'ios' ELSE 'android' END AS platform, id % 4 AS n_screens, CASE WHEN id % 5 > 0 THEN '17.0' END AS max_version, 's' || (id % 3) AS source, 'b' || (id % 7) AS batch, id * 2 AS line, brand FROM devices)"""
REFERENCE = "reference AS (SELECT id, CASE WHEN id % 8 = 0 THEN 'conditional' ELSE support END AS expected FROM devices WHERE id % 4 < 3)"


def _made(spark, sf):
    n = F.col("id")
    screens = F.when(n % 4 > 0, F.array_repeat(F.lit("1x1@1"), (n % 4).cast("int")))
    text = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    return devices(spark, sf).select("id", F.when(n % 9 == 0, "unknown").otherwise(F.col("support")).alias("support"), "confidence", F.when(n % 3 == 0, "ios").otherwise("android").alias("platform"), screens.alias("screens"), F.when(n % 5 > 0, "17.0").alias("max_version"), text("s", 3).alias("source"), text("b", 7).alias("batch"), (n * 2).alias("line"), "brand")


def _reference(spark, sf):
    return devices(spark, sf).where("id % 4 < 3").select("id", F.when(F.col("id") % 8 == 0, "conditional").otherwise(F.col("support")).alias("support"))


@query(f"WITH {DEVICES}, {MADE} SELECT id, platform = 'ios' AND (n_screens = 0 OR max_version IS NULL) AS kept_out, CASE WHEN platform = 'ios' AND (n_screens = 0 OR max_version IS NULL) THEN 'IOS_FIELDS_MISSING' END AS notice, CASE WHEN platform = 'ios' AND (n_screens = 0 OR max_version IS NULL) THEN source || ':' || batch || ':' || line END AS place FROM made")
def load_guard(spark, sf):
    good, notices, bad = reports.load_guard(_made(spark, sf))
    none = F.lit(None).cast("string")
    out = bad.join(notices.withColumnRenamed("code", "notice"), "id").select("id", F.lit(True).alias("kept_out"), "notice", F.concat_ws(":", "source", "batch", "line").alias("place"))
    return out.unionByName(good.select("id", F.lit(False).alias("kept_out"), none.alias("notice"), none.alias("place")))


@query(f"WITH {DEVICES}, {MADE}, {REFERENCE} SELECT m.id, CASE WHEN m.support = 'unknown' THEN 'unknown' WHEN r.id IS NULL THEN 'not-in-reference' WHEN m.support = r.expected THEN 'match' ELSE 'contradict' END AS outcome FROM made m LEFT JOIN reference r USING (id)")
def reference_check(spark, sf):
    return reports.reference_check(_made(spark, sf), _reference(spark, sf), "id", "support").select("id", "outcome")


@query(f"WITH {DEVICES}, {MADE}, {REFERENCE}, c AS (SELECT m.support = r.expected AS ok FROM made m JOIN reference r USING (id) WHERE m.support <> 'unknown') SELECT count(*) AS checked, CAST(count_if(ok) AS BIGINT) AS matched, round(1 - count_if(ok) / count(*), 9) AS rate FROM c")
def mismatch_rate(spark, sf):
    checked = reports.reference_check(_made(spark, sf), _reference(spark, sf), "id", "support")
    return reports.mismatch_rate(checked).withColumn("rate", F.round("rate", 9))


def _disagreements(spark, sf):
    first = cat.one_per_source(votes(spark, sf), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])
    split = cat.consensus(first, "l_partkey", "support").where("outcome = 'quarantined'").select("l_partkey")
    said = first.where("support <> 'unknown'").join(split, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.array_sort(F.collect_set("support")).alias("variants"))
    return said.select(F.col("l_partkey").alias("device"), "variants")


@query(f"""WITH {DEVICES}, {MADE}, {VOTES}, v AS (SELECT l_partkey, list_sort(list_distinct(list(support))) AS variants FROM votes WHERE support <> 'unknown' GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT support) > 1 AND count_if(support = 'conditional') = 0)
SELECT 'csv_quarantine' AS kind, 'IOS_FIELDS_MISSING:' || source || ':' || batch || ':' || line AS key, '{{"code":"IOS_FIELDS_MISSING","source":"' || source || '","batch":"' || batch || '","line":' || line || ',"detail":"no screens"}}' AS payload FROM made WHERE platform = 'ios' AND (n_screens = 0 OR max_version IS NULL)
UNION ALL SELECT 'source_disagreement', l_partkey::VARCHAR, '{{"device":' || l_partkey || ',"variants":["' || array_to_string(variants, '","') || '"]}}' FROM v""")
def rejection_tasks(spark, sf):
    bad = reports.load_guard(_made(spark, sf))[2].withColumn("detail", F.lit("no screens"))
    return reports.rejection_tasks(bad, _disagreements(spark, sf))


@query(f"""WITH {DEVICES}, {MADE}, {REFERENCE}, bad AS (SELECT * FROM made WHERE platform = 'ios' AND (n_screens = 0 OR max_version IS NULL)), d AS (SELECT * FROM made WHERE id NOT IN (SELECT id FROM bad)), old AS (SELECT id, support, confidence FROM devices WHERE id % 10 > 0),
ev AS (SELECT event_type, count(*) AS n, count_if(value > 50) AS r, count_if(value < 1) AS e FROM events GROUP BY 1), c AS (SELECT d.support = r.expected AS ok FROM d JOIN reference r USING (id) WHERE d.support <> 'unknown'),
x AS (SELECT coalesce(d.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN d.id IS NULL THEN 'removed' WHEN o.support <> d.support OR o.confidence <> d.confidence THEN 'changed' END AS change FROM d FULL JOIN old o ON o.id = d.id)
SELECT section, name, round(CAST(value AS DOUBLE), 9) AS value, examples FROM (
 SELECT 'totals' AS section, 'lines parsed' AS name, sum(n) AS value, '' AS examples FROM ev UNION ALL SELECT 'totals', 'lines realigned', sum(r), '' FROM ev UNION ALL SELECT 'totals', 'without data', sum(e), '' FROM ev UNION ALL SELECT 'totals', 'accepted', count(*), '' FROM d UNION ALL SELECT 'totals', 'quarantined', count(*), '' FROM bad
 UNION ALL SELECT 'quarantine', 'IOS_FIELDS_MISSING', count(*), (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT source || '/' || batch || ':' || lpad(line::VARCHAR, 9, '0') || ' x' AS p FROM bad ORDER BY 1 LIMIT 3)) FROM bad
 UNION ALL SELECT 'code patterns', split_part(brand, '-', 1), count(*), '' FROM made WHERE id % 6 = 0 GROUP BY 2
 UNION ALL SELECT 'reference', 'checked', count(*), '' FROM c UNION ALL SELECT 'reference', 'matched', count_if(ok), '' FROM c UNION ALL SELECT 'reference', 'mismatch rate', 1 - count_if(ok) / count(*), '' FROM c
 UNION ALL SELECT 'confidence', l, (SELECT count(*) FROM d WHERE confidence = l), '' FROM (VALUES ('verified'), ('derived'), ('unverified'), ('quarantined')) v(l)
 UNION ALL SELECT 'since the last import', l, (SELECT count(*) FROM x WHERE change = l), '' FROM (VALUES ('added'), ('removed'), ('changed')) v(l))""")
def import_report(spark, sf):
    made = _made(spark, sf)
    good, _, bad = reports.load_guard(made)
    files = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("parsed"), F.count_if(F.col("value") > 50).alias("realigned"), F.count_if(F.col("value") < 1).alias("empty"))
    notices = made.where("id % 6 = 0").select(F.lit("CODE_PATTERN_INVALID").alias("code"), F.concat_ws("-", "brand", "id").alias("id"))
    old = devices(spark, sf).where("id % 10 > 0").select("id", "support", "confidence")
    report = reports.import_report(files, good, bad.withColumn("detail", F.lit("x")), notices, reports.reference_check(good, _reference(spark, sf), "id", "support"), old)
    return report.select("section", "name", F.round("value", 9).alias("value"), F.array_join("examples", "|").alias("examples"))


@query(f"""WITH {DEVICES}, {MADE}, s AS (SELECT d.id, 'Title ' || d.brand AS brand_title, d.name AS display_name, d.id % 13 > 0 AS active, m.platform, d.brand FROM devices d JOIN made m USING (id))
SELECT id, brand_title, display_name, count(*) OVER () AS total FROM s WHERE active AND platform = 'ios' ORDER BY brand_title, display_name, id LIMIT 30 OFFSET 60""")
def catalog_page(spark, sf):
    return reports.browse(_shown(spark, sf), 3, 30, platform="ios")


def _shown(spark, sf):
    d = devices(spark, sf).join(_made(spark, sf).select("id", "platform"), "id")
    return d.select("id", "brand", F.concat(F.lit("Title "), "brand").alias("brand_title"), F.col("name").alias("display_name"), "platform", F.when(F.col("id") % 13 > 0, "active").otherwise("deprecated").alias("status"))


@query(f"WITH {DEVICES} SELECT brand, 'Title ' || brand AS brand_title, count(*) AS devices FROM devices WHERE id % 13 > 0 GROUP BY 1")
def catalog_brands(spark, sf):
    return reports.brands(_shown(spark, sf))


@query(f"""WITH {DEVICES}, p AS (SELECT id, id % 3 = 0 AS hit, id % 2 = 0 AS sets_support, id % 5 < 3 AS sets_question FROM devices)
SELECT d.id, CASE WHEN hit AND id % 4 = 0 THEN 'curated' ELSE confidence END AS confidence, CASE WHEN hit AND sets_support AND id % 7 > 0 THEN 'not_supported' ELSE support END AS support, CASE WHEN hit AND sets_question THEN CASE WHEN id % 10 > 0 THEN 'new question' END ELSE 'old question' END AS question FROM devices d JOIN p USING (id)""")
def override_parts(spark, sf):
    n = F.col("id")
    esim = lambda s, q: F.struct(s.alias("support"), q.alias("question"))
    base = devices(spark, sf).select("id", "confidence", esim(F.col("support"), F.lit("old question")).alias("esim"))
    named = F.filter(F.array(F.when(n % 4 == 0, "confidence"), F.when(n % 2 == 0, "esim.support"), F.when(n % 5 < 3, "esim.question")), lambda x: x.isNotNull())
    patch = devices(spark, sf).where("id % 3 = 0").select("id", named.alias("set"), F.lit("curated").alias("confidence"), esim(F.when(n % 7 > 0, "not_supported"), F.when(n % 10 > 0, "new question")).alias("esim"))
    return cat.merge_override(base, patch, "id", ["confidence"], {"esim": ["support", "question"]}, ["esim.question"]).select("id", "confidence", "esim.support", "esim.question")
