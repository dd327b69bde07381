"""Queries over suggestions, identities, traces and reports, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import catalogue as cat
from quern.plans.inputs import DEVICES, VOTES, devices, table, votes
from quern.plans.queries import STOP, SYNONYMS, query

#: First pattern that a code matches, in this order.
BRAND_PATTERNS = {"early": "^SM-[0-9]{1,2}$", "middle": "^SM-[0-9]{3}$", "late": "^SM-"}
# The keys of the Latin layout, and what the Russian layout has on them.
LATIN_KEYS, RUSSIAN_KEYS = "abcdefghijklmnopqrstuvwxyz", "фисвуапршолдьтщзйкыегмцчня"
KNOWN = sorted({w for k, v in SYNONYMS.items() for w in (k, *v)})


@query(f"""WITH {DEVICES} SELECT id, CASE WHEN regexp_matches(code, '^SM-[0-9]{{1,2}}$') THEN 'early' WHEN regexp_matches(code, '^SM-[0-9]{{3}}$') THEN 'middle'
  WHEN regexp_matches(code, '^SM-') THEN 'late' END AS guess FROM devices""")
def brand_guess(spark, sf):
    return devices(spark, sf).select("id", rules.first_match(F.col("code"), BRAND_PATTERNS).alias("guess"))


@query(r"""WITH plain AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split(t, ' '), lambda w: w NOT IN ('', 'old', 'new')), '-') AS slug FROM plain""")
def device_slug(spark, sf):
    named = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" (Dual SIM)"))
    return table(spark, sf, "part").select("p_partkey", text.device_slug(named, STOP).alias("slug"))


@query(f"""WITH {DEVICES}, asked AS (SELECT s_suppkey, 'SM-' || CAST(s_suppkey * 7 AS VARCHAR) AS code FROM supplier),
pairs AS (SELECT a.s_suppkey, d.id, list_max(list_filter(range(1, 12), lambda i: i <= length(a.code) AND i <= length(d.code) AND a.code[1:i] = d.code[1:i])) AS shared
  FROM asked a JOIN devices d ON a.code[1:4] = d.code[1:4]),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY shared DESC, id) AS rank FROM pairs)
SELECT s_suppkey, id, CAST(shared AS INTEGER) AS shared, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def code_suggestions(spark, sf):
    asked = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("SM-"), (F.col("s_suppkey") * 7).cast("string")).alias("code"))
    return cat.prefix_suggestions(asked, devices(spark, sf).select("id", "code"), "s_suppkey", "id", "code")


@query(f"""WITH RECURSIVE {DEVICES}, keyed AS (
  SELECT id, 'code ' || code || ' ' || family AS key FROM devices
  UNION SELECT id, 'line ' || brand || ' ' || family || ' ' || modifier || ' ' || generation FROM devices),
edges AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keyed a JOIN keyed b USING (key)),
reach AS (SELECT id, id AS low FROM devices UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.id)
SELECT id, min(low) AS component FROM reach GROUP BY id""")
def identity_components(spark, sf):
    d = devices(spark, sf)
    line = F.concat_ws(" ", F.lit("line"), "brand", "family", "modifier", "generation")
    keyed = d.select("id", F.explode(F.array(F.concat_ws(" ", F.lit("code"), "code", "family"), line)).alias("key"))
    return cat.components(keyed, "id", "key")


@query(f"""WITH {DEVICES}, r AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY id) AS n FROM devices WHERE support <> 'supported')
SELECT confidence, max(n) AS total, string_agg(CASE WHEN n <= 3 THEN CAST(id AS VARCHAR) END, ',' ORDER BY n) AS examples FROM r GROUP BY confidence""")
def group_examples(spark, sf):
    rows = devices(spark, sf).where("support <> 'supported'").select("confidence", "id")
    return cat.first_examples(rows, "confidence", "id", 3).withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {DEVICES}, {VOTES}, judged AS (SELECT d.brand, d.support AS expected, v.support AS given FROM votes v JOIN devices d ON d.id = v.l_partkey),
counted AS (SELECT coalesce(brand, 'total') AS category, count(*) AS total, count_if(expected = given) AS correct,
  count_if(given = 'supported' AND expected <> 'supported') AS false_positive, count_if(given = 'unknown') AS unanswered FROM judged GROUP BY ROLLUP (brand))
SELECT *, CASE WHEN total = 0 THEN '—' ELSE CAST(((2000 * correct + total) // (2 * total)) // 10 AS VARCHAR) || '.' || CAST(((2000 * correct + total) // (2 * total)) % 10 AS VARCHAR) END AS percent FROM counted WHERE total > 0""")
def category_metrics(spark, sf):
    given = cat.one_per_source(votes(spark, sf), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "support"])
    d = devices(spark, sf).select(F.col("id").alias("l_partkey"), F.col("brand").alias("category"), F.col("support").alias("expected"))
    return cat.category_metrics(given.join(d, "l_partkey"), "category", "expected", "support", "supported", "unknown")


@query(f"""WITH {DEVICES}, raw AS (SELECT id, ' region: CN/hk,' || upper(family) || ' = no;os_version:' || generation || '=да; firmware:9=yes;junk;' AS t FROM devices),
parts AS (SELECT id, unnest(string_split(t, ';')) AS part FROM raw),
cut AS (SELECT id, regexp_extract(part, '^\\s*([A-Za-z_]+)\\s*:\\s*([^=]*?)\\s*=\\s*(\\S+)\\s*$', ['scope', 'vals', 'said']) AS g FROM parts)
SELECT id, CASE g.scope WHEN 'region' THEN 'region' ELSE 'osVersion' END AS scope, trim(unnest(string_split(replace(g.vals, ',', '/'), '/'))) AS value,
  CASE g.said WHEN 'no' THEN 'not_supported' ELSE 'supported' END AS support FROM cut WHERE g.scope IN ('region', 'os_version')""")
def condition_parse(spark, sf):
    raw = F.concat(F.lit(" region: CN/hk,"), F.upper("family"), F.lit(" = no;os_version:"), F.col("generation").cast("string"), F.lit("=да; firmware:9=yes;junk;"))
    return devices(spark, sf).select("id", F.inline(text.parse_conditions(raw)))


@query(f"""WITH {DEVICES}, typed AS (SELECT id, string_split(translate(modifier || ' ' || family, '{LATIN_KEYS}', '{RUSSIAN_KEYS}'), ' ') AS words FROM devices)
SELECT id, array_to_string(list_transform(words, lambda w: CASE WHEN translate(w, '{RUSSIAN_KEYS}', '{LATIN_KEYS}') IN ({", ".join(f"'{k}'" for k in KNOWN)})
  THEN translate(w, '{RUSSIAN_KEYS}', '{LATIN_KEYS}') ELSE w END), ' ') AS repaired FROM typed""")
def keyboard_repair(spark, sf):
    typed = F.split(F.translate(F.concat_ws(" ", "modifier", "family"), LATIN_KEYS, RUSSIAN_KEYS), " ")
    return devices(spark, sf).select("id", F.array_join(text.repair_keyboard(typed, RUSSIAN_KEYS, LATIN_KEYS, KNOWN), " ").alias("repaired"))


@query(f"""WITH {DEVICES} SELECT id, to_json({{'id': id, 'brand': brand, 'support': support}}) AS document FROM devices WHERE starts_with(CASE WHEN generation % 3 = 0 THEN 'moderator:' || brand ELSE 'import' END, 'moderator:')""")
def override_export(spark, sf):
    origin = F.when(F.col("generation") % 3 == 0, F.concat(F.lit("moderator:"), "brand")).otherwise("import")
    return cat.exported(devices(spark, sf).withColumn("origin", origin), "origin", "moderator:", ["id", "brand", "support"])
