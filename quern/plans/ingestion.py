"""Queries over raw rows on their way into the catalogue, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import query as query_words
from quern.functions import rules, text
from quern.operators import catalogue as cat
from quern.operators import ingestion
from quern.plans.inputs import DEVICES, VOTES, devices, table, votes
from quern.plans.queries import query

BRANDS, NOW = [f"brand#{i}" for i in range(1, 24)], 2024
#: Raw rows made of orders, with damage of every kind.
RAW_FIELDS = {
    "platform": "CASE o_orderkey % 11 WHEN 0 THEN 'symbian' WHEN 1 THEN NULL WHEN 2 THEN ' iOS ' ELSE 'android' END",
    "device_type": "CASE o_orderkey % 13 WHEN 0 THEN 'fridge' WHEN 1 THEN 'Tablet' ELSE 'phone' END",
    "esim_support": "CASE o_orderkey % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN 'YES' WHEN 2 THEN 'conditional' WHEN 3 THEN 'unknown' ELSE 'no' END",
    "dual_sim": "CASE o_orderkey % 17 WHEN 0 THEN 'three' WHEN 1 THEN 'none' END",
    "ru_market": "CASE o_orderkey % 19 WHEN 0 THEN 'grey' WHEN 1 THEN ' Official' END",
    "confidence": "CASE o_orderkey % 23 WHEN 0 THEN '' WHEN 1 THEN 'high' END",
    "brand": "CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE ' Brand#' || (o_custkey % 26) END",
    "marketing_name": "CASE o_orderkey % 31 WHEN 0 THEN ' * ' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'Nova ' || (o_custkey % 40) END",
    "release_year": "CASE o_orderkey % 37 WHEN 0 THEN 'soon' WHEN 1 THEN '2006' WHEN 2 THEN '2026' WHEN 3 THEN '2019 (May)' ELSE CAST(2008 + o_custkey % 17 AS VARCHAR(9)) END",
    "esim_conditions": "CASE o_orderkey % 5 WHEN 0 THEN 'region:CN=no' WHEN 1 THEN 'nonsense' WHEN 2 THEN '' END",
}
RAW = "raw AS (SELECT o_orderkey, " + ", ".join(f"{v} AS {k}" for k, v in RAW_FIELDS.items()) + " FROM orders)"


def raw_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in RAW_FIELDS.items()])


CODES = (
    f"""WITH {RAW}, y AS (SELECT *, TRY_CAST(regexp_extract(release_year, '^[0-9]+') AS INTEGER) AS year FROM raw),
codes AS (SELECT *, CASE WHEN platform IS NULL OR lower(trim(platform)) NOT IN ('ios', 'android', 'harmonyos', 'other') OR lower(device_type) NOT IN ('phone', 'tablet', 'watch', 'laptop', 'other') OR lower(esim_support) NOT IN ('yes', 'no', 'conditional', 'unknown')
    OR dual_sim = 'three' OR ru_market = 'grey' OR confidence = '' THEN 'ENUM_INVALID'
  WHEN brand IS NULL OR lower(trim(brand)) NOT IN ("""
    + ", ".join(f"'{b}'" for b in BRANDS)
    + """) THEN 'BRAND_UNKNOWN' WHEN marketing_name IS NULL OR NOT regexp_matches(marketing_name, '[A-Za-z0-9]') THEN 'NAME_UNPARSEABLE' WHEN year IS NULL OR year < 2007 OR year > 2025 THEN 'YEAR_IMPLAUSIBLE'
  WHEN year < 2017 AND lower(esim_support) IN ('yes', 'conditional') THEN 'ESIM_ANACHRONISM' WHEN esim_support = 'conditional' AND coalesce(esim_conditions, '') <> 'region:CN=no' THEN 'CONDITION_SYNTAX_INVALID' END AS code FROM y)"""
)


@query(CODES + " SELECT code, count(*) AS n, min(o_orderkey) AS first_row, max(o_orderkey) AS last_row FROM codes GROUP BY 1")
def validate_chain(spark, sf):
    return raw_rows(spark, sf).groupBy(ingestion.quarantine_code(BRANDS, NOW).alias("code")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_row"), F.max("o_orderkey").alias("last_row"))


@query(CODES + """, c AS (SELECT code, o_orderkey, row_number() OVER (PARTITION BY code ORDER BY o_orderkey) AS n FROM codes WHERE code IS NOT NULL)
SELECT code, count(*) AS total, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FILTER (n <= 3) AS examples FROM c GROUP BY 1""")
def quarantine_counts(spark, sf):
    bad = raw_rows(spark, sf).select("o_orderkey", ingestion.quarantine_code(BRANDS, NOW).alias("code")).where("code is not null")
    return cat.first_examples(bad, "code", "o_orderkey", 3).withColumn("examples", F.array_join("examples", ","))


@query(f"""WITH {DEVICES}, r AS (SELECT id, 'AC-' || generation || '| ;bad code; AC-' || id || 'X ;' AS codes, CASE WHEN id % 3 > 0 THEN '^AC-[0-9]+$' END AS pattern, 'v' || (generation % 20) || '.5 beta' AS v FROM devices)
SELECT id, CASE WHEN pattern IS NULL THEN 'AC-' || split_part(split_part(codes, '|', 1), '-', 2) || '|bad code|AC-' || id || 'X' ELSE split_part(codes, '|', 1) END AS codes, CASE WHEN CAST(regexp_extract(v, '[0-9]+') AS INTEGER) < 15 THEN v END AS version FROM r""")
def row_notices(spark, sf):
    g = F.col("generation")
    raw = F.concat(F.lit("AC-"), g.cast("string"), F.lit("| ;bad code; AC-"), F.col("id").cast("string"), F.lit("X ;"))
    kept = text.split_codes(raw, F.when(F.col("id") % 3 > 0, F.lit("^AC-[0-9]+$")))
    version = ingestion.below_ceiling(F.concat(F.lit("v"), (g % 20).cast("string"), F.lit(".5 beta")), 15)
    return devices(spark, sf).select("id", F.array_join(kept, "|").alias("codes"), version.alias("version"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, l_orderkey * 8 + l_linenumber AS ord, l_shipdate, CASE WHEN l_quantity < 45 THEN 'no' ELSE 'yes' END AS support, 'C' || (l_orderkey % 7) AS code FROM lineitem),
g AS (SELECT l_suppkey, l_partkey, count(*) AS n, count(DISTINCT support) AS kinds, min(support) AS s, epoch_us(arg_min(l_shipdate, ord)) AS first_us FROM r GROUP BY 1, 2),
c AS (SELECT l_suppkey, l_partkey, string_agg(code, '|' ORDER BY first_ord) AS codes FROM (SELECT l_suppkey, l_partkey, code, min(ord) AS first_ord FROM r GROUP BY ALL) GROUP BY 1, 2)
SELECT l_suppkey, l_partkey, n, CASE WHEN kinds > 1 THEN 'mixed' ELSE s END AS support, CASE WHEN kinds > 1 THEN 'quarantined' WHEN n > 1 THEN 'merged' ELSE 'single' END AS outcome, first_us, codes FROM g JOIN c USING (l_suppkey, l_partkey)""")
def id_collisions(spark, sf):
    r = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "l_shipdate", F.when(F.col("l_quantity") < 45, "no").otherwise("yes").alias("support"), F.array(F.concat(F.lit("C"), (F.col("l_orderkey") % 7).cast("string"))).alias("codes"))
    m = ingestion.merge_ids(r, ["l_suppkey", "l_partkey"], "ord", "support", "codes")
    return m.select("l_suppkey", "l_partkey", "n", "support", "outcome", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("first_us"), F.array_join("codes", "|").alias("codes"))


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, year(l_shipdate) AS y, CASE WHEN l_tax > 0.02 THEN l_returnflag END AS flag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_tax > 0.02 THEN l_returnflag END NULLS FIRST, year(l_shipdate)) AS n FROM lineitem),
y AS (SELECT l_partkey, y AS v, count(*) AS c FROM r GROUP BY 1, 2), f AS (SELECT l_partkey, flag AS v, count(*) AS c FROM r WHERE flag IS NOT NULL GROUP BY 1, 2),
ym AS (SELECT l_partkey, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM (SELECT *, max(c) OVER (PARTITION BY l_partkey) AS m FROM y) WHERE c = m GROUP BY 1),
fm AS (SELECT l_partkey, CASE WHEN count(*) = 1 THEN min(v) END AS v FROM (SELECT *, max(c) OVER (PARTITION BY l_partkey) AS m FROM f) WHERE c = m GROUP BY 1)
SELECT r.l_partkey, r.l_suppkey, fm.v AS flag, CAST(coalesce(ym.v, r.y) AS INTEGER) AS y FROM r JOIN ym USING (l_partkey) LEFT JOIN fm USING (l_partkey) WHERE r.n = 1""")
def representative(spark, sf):
    r = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("flag"))
    return ingestion.representative(r, "l_partkey", ["l_orderkey", "l_linenumber"], ["l_suppkey"], ["flag"], ["y"])


@query("""WITH r AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS ord, CASE WHEN l_orderkey % 2 = 0 THEN 'region' ELSE 'osVersion' END AS scope, CAST(l_orderkey % 4 AS VARCHAR) AS value, 'no' AS support, 'n' || l_linenumber || '-' || l_orderkey AS note FROM lineitem WHERE l_returnflag = 'N'),
c AS (SELECT l_partkey, scope, value, min(ord) AS first_ord, arg_max(note, ord) AS note FROM r GROUP BY 1, 2, 3)
SELECT l_partkey, string_agg(scope || ':' || value || '=' || note, ';' ORDER BY first_ord) AS conditions FROM c GROUP BY 1""")
def condition_union(spark, sf):
    o = F.col("l_orderkey")
    r = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_partkey", (o * 8 + F.col("l_linenumber")).alias("ord"), F.when(o % 2 == 0, "region").otherwise("osVersion").alias("scope"), (o % 4).cast("string").alias("value"), F.lit("no").alias("support"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string"), F.lit("-"), o.cast("string")).alias("note"))
    c = ingestion.condition_union(r, "l_partkey", ["ord"])
    return c.select("l_partkey", F.array_join(F.transform("conditions", lambda x: F.concat(x["scope"], F.lit(":"), x["value"], F.lit("="), x["note"])), ";").alias("conditions"))


MERGE = f"""{DEVICES}, {VOTES}, n AS (SELECT l_partkey, count_if(support <> 'unknown') AS t, count(DISTINCT support) FILTER (support <> 'unknown') AS k FROM votes GROUP BY 1),
d AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'apple' ELSE brand END AS brand, CASE WHEN id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform, CASE id % 4 WHEN 0 THEN 'iphone' WHEN 1 THEN 'iphone-x' ELSE family END AS family, CASE WHEN generation % 6 > 0 THEN generation END AS generation, support, CASE WHEN id % 10 = 0 THEN 'supported' END AS curated FROM devices)"""


@query(f"""WITH {MERGE}, s AS (SELECT d.*, coalesce(n.t, 0) AS t, CASE WHEN platform <> 'ios' OR brand <> 'apple' THEN NULL WHEN family = 'iphone-x' THEN 'not_supported' WHEN family = 'iphone' AND generation > 8 THEN 'supported' WHEN family = 'iphone' AND generation <= 8 THEN 'not_supported' END AS ruled FROM d LEFT JOIN n ON l_partkey = id)
SELECT id, CASE WHEN curated IS NOT NULL THEN 'curated' WHEN ruled IS NOT NULL THEN 'rule' ELSE 'import' END AS source, coalesce(curated, ruled, support) AS status, curated IS NULL AND ruled IS NOT NULL AND ruled <> support AS conflict,
  CASE WHEN curated IS NOT NULL OR ruled IS NOT NULL THEN 'verified' WHEN t = 1 THEN 'unverified' ELSE 'derived' END AS confidence FROM s""")
def merge_precedence(spark, sf):
    n, g = F.col("id"), F.col("generation")
    d = devices(spark, sf).select("id", F.when(n % 3 == 0, "apple").otherwise(F.col("brand")).alias("brand"), F.when(n % 2 == 0, "ios").otherwise("android").alias("platform"), F.when(n % 4 == 0, "iphone").when(n % 4 == 1, "iphone-x").otherwise(F.col("family")).alias("family"), F.when(g % 6 > 0, g).alias("generation"), "support", F.when(n % 10 == 0, "supported").alias("curated"))
    first = cat.one_per_source(votes(spark, sf), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber", "support"])
    d = d.join(cat.consensus(first, "l_partkey", "support").select(F.col("l_partkey").alias("id"), "outcome"), "id", "left")
    source = ingestion.merge_source(F.col("curated"), F.col("brand"), F.col("platform"), F.col("family"), F.col("generation"))
    ruled = rules.generation_rule(F.col("family"), F.col("generation"))
    d = d.withColumn("source", source).withColumn("status", F.when(F.col("source") == "curated", F.col("curated")).when(F.col("source") == "rule", ruled).otherwise(F.col("support")))
    return d.select("id", "source", "status", ((F.col("source") == "rule") & (F.col("status") != F.col("support"))).alias("conflict"), ingestion.data_confidence(F.col("source"), F.col("outcome")).alias("confidence"))


QUESTIONS = {"region": "Where was it bought?", "osVersion": "Which version does it run?"}


@query(f"""WITH {DEVICES} SELECT id, round(greatest(0, least(1, (2000 + generation - 2007) / 17.0)), 9) AS popularity, CASE WHEN id % 3 > 0 THEN CASE WHEN id % 3 = 1 THEN 'region' ELSE 'osVersion' END END AS kind,
  CASE id % 3 WHEN 1 THEN 'Where was it bought?' WHEN 2 THEN 'Which version does it run?' END AS question, CASE id % 3 WHEN 1 THEN 'CN|HK|other' WHEN 2 THEN generation || '|other' END AS options FROM devices""")
def device_build(spark, sf):
    n, g = F.col("id") % 3, F.col("generation")
    raw = F.when(n == 1, "region:CN/HK,CN=no;osVersion:9=no").when(n == 2, F.concat(F.lit("osVersion:"), g.cast("string"), F.lit("=no;region:US=no"))).otherwise("")
    q = ingestion.clarifying_question(text.parse_conditions(raw), QUESTIONS)
    return devices(spark, sf).select("id", F.round(ingestion.popularity(2000 + g, NOW), 9).alias("popularity"), q.alias("q")).select("id", "popularity", "q.kind", "q.question", F.array_join("q.options", "|").alias("options"))


PARENTS = {"red": "colour", "blue": "colour", "old": "age"}


@query(f"""WITH {DEVICES}, r AS (SELECT id, CASE id % 4 WHEN 0 THEN 'colour' WHEN 1 THEN 'age' WHEN 2 THEN 'red' ELSE 'other' END AS brand, name FROM devices)
SELECT id, CASE WHEN brand = 'colour' AND split_part(name, ' ', 1) IN ('red', 'blue') THEN split_part(name, ' ', 1) WHEN brand = 'age' AND split_part(name, ' ', 1) = 'old' THEN 'old' WHEN brand = 'red' THEN 'red' END AS subbrand,
  CASE WHEN (brand = 'colour' AND split_part(name, ' ', 1) IN ('red', 'blue')) OR (brand = 'age' AND split_part(name, ' ', 1) = 'old') THEN trim(substr(name, length(split_part(name, ' ', 1)) + 1)) ELSE name END AS remainder FROM r""")
def subbrand_identity(spark, sf):
    n = F.col("id") % 4
    brand = F.when(n == 0, "colour").when(n == 1, "age").when(n == 2, "red").otherwise("other")
    return devices(spark, sf).select("id", ingestion.subbrand_identity(brand, F.initcap(F.concat(brand, F.lit("  "), "name")), PARENTS).alias("s")).select("id", "s.*")


#: A catalogue with breaches of all seven invariants.
BROKEN = """broken AS (SELECT CASE WHEN id % 97 = 0 THEN id + 1 ELSE id END AS id, id AS ord, brand, CASE WHEN id % 5 = 0 THEN brand ELSE family END AS family, name || ' ' || brand || ' ' || generation AS name, code, CASE WHEN id % 4 = 0 THEN 'alias ' || (id % 300) END AS alias,
  CASE WHEN id % 3 = 0 THEN 'ios' ELSE 'android' END AS platform, support, confidence, id % 6 > 0 AS screens, CASE WHEN id % 9 > 0 THEN '17' END AS max_version, id % 8 > 0 AS conditions, id % 10 > 0 AS question, id % 7 > 0 AS sources FROM devices)"""
SIGNS = """signs AS (SELECT id // 3 AS screen, unnest([id, id + 1, CASE WHEN id % 4 = 0 THEN -id - 1 ELSE id END]) AS id, CASE WHEN id % 2 = 0 THEN 'mixed' ELSE support END AS consensus FROM devices WHERE id % 3 = 0)"""
BREACHES = f"""{DEVICES}, {BROKEN}, {SIGNS}, firsts AS (SELECT id, support FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM broken) WHERE n = 1),
names AS (SELECT id, support, lower(alias) AS key FROM broken WHERE alias IS NOT NULL UNION ALL SELECT id, support, lower(name) FROM broken WHERE family <> brand),
codes AS (SELECT id, ord, upper(code) AS key, first_value(id) OVER (PARTITION BY upper(code) ORDER BY ord) AS owner FROM broken),
seen AS (SELECT screen, consensus, CASE WHEN min(f.support) = max(f.support) THEN min(f.support) ELSE 'mixed' END AS expected, count(f.support) AS n, string_agg(DISTINCT CAST(signs.id AS VARCHAR), ',' ORDER BY CAST(signs.id AS VARCHAR)) AS ids FROM signs LEFT JOIN firsts f USING (id) GROUP BY 1, 2),
v AS (SELECT 1 AS invariant, 'DUPLICATE_DEVICE_ID' AS code, CAST(id AS VARCHAR) AS ids FROM broken GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 2, 'DUPLICATE_MODEL_CODE', owner || ',' || id FROM codes WHERE id <> owner
 UNION ALL SELECT 3, 'CONFLICTING_ALIAS', string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FROM names GROUP BY key HAVING min(support) <> max(support)
 UNION ALL SELECT 4, 'IOS_SCREEN_SIGNATURES_MISSING', CAST(id AS VARCHAR) FROM broken WHERE platform = 'ios' AND NOT screens
 UNION ALL SELECT 4, 'IOS_MAX_VERSION_MISSING', CAST(id AS VARCHAR) FROM broken WHERE platform = 'ios' AND max_version IS NULL
 UNION ALL SELECT 5, 'CONDITIONAL_CONDITIONS_MISSING', CAST(id AS VARCHAR) FROM broken WHERE support = 'conditional' AND NOT conditions
 UNION ALL SELECT 5, 'CONDITIONAL_CLARIFYING_QUESTION_MISSING', CAST(id AS VARCHAR) FROM broken WHERE support = 'conditional' AND NOT question
 UNION ALL SELECT 6, 'SUPPORTED_SOURCES_MISSING', CAST(id AS VARCHAR) FROM broken WHERE support = 'supported' AND confidence = 'verified' AND NOT sources
 UNION ALL SELECT 7, 'SCREEN_SIGNATURE_UNKNOWN_CANDIDATE', CAST(id AS VARCHAR) FROM signs WHERE id NOT IN (SELECT id FROM broken)
 UNION ALL SELECT 7, 'SCREEN_SIGNATURE_CONSENSUS_MISMATCH', ids FROM seen WHERE n > 0 AND expected <> consensus)"""


def _broken(spark, sf):
    n, some = F.col("id"), lambda ok, *xs: F.when(ok, F.array(*xs)).otherwise(F.array().cast("array<string>"))
    d = devices(spark, sf)
    broken = d.select(F.when(n % 97 == 0, n + 1).otherwise(n).cast("string").alias("id"), n.alias("ord"), "brand", F.when(n % 5 == 0, F.col("brand")).otherwise(F.col("family")).alias("family"), F.concat_ws(" ", "name", "brand", F.col("generation").cast("string")).alias("name"), F.array("code").alias("codes"), some(n % 4 == 0, F.concat(F.lit("Alias "), (n % 300).cast("string"))).alias("aliases"), F.when(n % 3 == 0, "ios").otherwise("android").alias("platform"), "support", "confidence", some(n % 6 > 0, F.lit("s")).alias("screens"), F.when(n % 9 > 0, "17").alias("max_version"), some(n % 8 > 0, F.lit("c")).alias("conditions"), F.when(n % 10 > 0, "q").alias("question"), some(n % 7 > 0, F.lit("u")).alias("sources"))
    signs = d.where("id % 3 = 0").select(F.expr("id div 3").alias("screen"), F.transform(F.array(n, n + 1, F.when(n % 4 == 0, -n - 1).otherwise(n)), lambda x: x.cast("string")).alias("candidates"), F.when(n % 2 == 0, "mixed").otherwise(F.col("support")).alias("consensus"))
    return broken, signs


@query(f"WITH {BREACHES} SELECT CAST(invariant AS INTEGER) AS invariant, code, ids FROM v")
def invariant_violations(spark, sf):
    return ingestion.violations(*_broken(spark, sf)).select("invariant", "code", F.array_join("device_ids", ",").alias("ids"))


@query(f"WITH {BREACHES}, named AS (SELECT DISTINCT unnest(string_split(ids, ',')) AS id FROM v) SELECT platform, count(*) AS n, min(ord) AS first_ord FROM broken WHERE CAST(id AS VARCHAR) NOT IN (SELECT id FROM named) GROUP BY 1")
def invariant_quarantine(spark, sf):
    broken, signs = _broken(spark, sf)
    good, _ = ingestion.quarantined(broken, ingestion.violations(broken, signs))
    return good.groupBy("platform").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'да' WHEN 1 THEN ' НЕТ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'Conditional ' WHEN 5 THEN '1' WHEN 6 THEN 'false' END AS said FROM part)
SELECT p_partkey, CASE trim(lower(said)) WHEN 'да' THEN 'yes' WHEN 'нет' THEN 'no' WHEN 'true' THEN 'yes' WHEN '1' THEN 'yes' WHEN 'false' THEN 'no' WHEN '0' THEN 'no' ELSE trim(lower(said)) END AS answer FROM r""")
def yes_no_tokens(spark, sf):
    said = F.expr("CASE p_partkey % 8 WHEN 0 THEN 'да' WHEN 1 THEN ' НЕТ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'Conditional ' WHEN 5 THEN '1' WHEN 6 THEN 'false' END")
    return table(spark, sf, "part").select("p_partkey", text.yes_no(said).alias("answer"))


@query("""WITH r AS (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' s23u' WHEN 1 THEN ' a5' ELSE ' hot' END AS t FROM part)
SELECT p_partkey, array_to_string(flatten(list_transform(string_split(t, ' '), lambda w: CASE w WHEN 's23u' THEN ['galaxy', 's23', 'ultra'] WHEN 'a5' THEN ['galaxy', 'a5'] ELSE [w] END)), ' ') AS expanded FROM r""")
def compound_synonyms(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.concat("p_name", F.when(k == 0, " s23u").when(k == 1, " a5").otherwise(" hot"))
    return table(spark, sf, "part").select("p_partkey", text.expand_compounds(raw, {"s23u": ["galaxy", "s23", "ultra"], "a5": ["galaxy", "a5"], "hot": ["heat", "proof"]}).alias("expanded"))


@query()
def unicode_forms(spark, sf):
    raw = F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit("1"), F.lit("①"))
    return table(spark, sf, "documents").select("doc_id", text.unicode_form(raw).alias("folded"))


@query("""WITH c AS (SELECT DISTINCT p_name AS n FROM part), m(w) AS (VALUES ('pro'), ('max'), ('plus'), ('ultra'), ('mini'), ('lite'), ('air'), ('fold'), ('flip')),
t AS (SELECT DISTINCT substr(n, i, 4) AS t FROM c, unnest([1, 2, 3, 5]) AS x(i) UNION SELECT left(w, length(w) - 1) || z FROM m, unnest(['', 'x', 'qq']) AS y(z) UNION SELECT substr(w, 2, 1) || left(w, 1) || substr(w, 3) FROM m),
p AS (SELECT t, w FROM t, m WHERE length(t) >= 3 AND length(w) >= 3)
SELECT t AS token, w AS modifier,
  (length(t) = length(w) AND ((SELECT count(*) FROM range(1, length(w) + 1) r(i) WHERE t[i] <> w[i]) = 1 OR
     (SELECT count(*) FROM range(1, length(w)) r(i) WHERE t[1:i - 1] = w[1:i - 1] AND t[i] = w[i + 1] AND t[i + 1] = w[i] AND t[i] <> t[i + 1] AND substr(t, i + 2) = substr(w, i + 2)) > 0))
  OR (length(t) = length(w) + 1 AND (SELECT count(*) FROM range(1, length(t) + 1) r(i) WHERE left(t, i - 1) || substr(t, i + 1) = w) > 0)
  OR (length(w) = length(t) + 1 AND (SELECT count(*) FROM range(1, length(w) + 1) r(i) WHERE left(w, i - 1) || substr(w, i + 1) = t) > 0) AS near FROM p""")
def single_edit(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    mods = spark.createDataFrame([(w,) for w in query_words.MODIFIERS if len(w) >= 3], "modifier string")
    cut = names.select(F.explode(F.array(*[F.substring("p_name", i, 4) for i in (1, 2, 3, 5)])).alias("token"))
    w = F.col("modifier")
    bent = mods.select(F.explode(F.array(*[F.concat(F.expr("left(modifier, length(modifier) - 1)"), F.lit(z)) for z in ("", "x", "qq")], F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, 3, 9)))).alias("token"))
    # Each token meets the nine modifiers as a list of its own row.
    tokens = cut.unionByName(bent).distinct().where(F.length("token") >= 3)
    return tokens.select("token", F.explode(F.array(*[F.lit(m) for m in query_words.MODIFIERS if len(m) >= 3])).alias("modifier")).select("token", "modifier", text.single_edit(F.col("token"), F.col("modifier")).alias("near"))


EDITED = BREACHES.replace(BROKEN, BROKEN.replace("broken AS", "before AS", 1) + """, edited AS (SELECT * REPLACE ('conditional' AS support, FALSE AS question) FROM before WHERE ord % 50 < 2),
broken AS (SELECT * FROM before WHERE id NOT IN (SELECT id FROM edited) UNION ALL SELECT * FROM edited)""")


@query(f"WITH {EDITED}, named AS (SELECT DISTINCT invariant, code, ids FROM (SELECT *, unnest(string_split(ids, ',')) AS id FROM v WHERE code <> 'SCREEN_SIGNATURE_CONSENSUS_MISMATCH') WHERE id IN (SELECT CAST(id AS VARCHAR) FROM edited)) SELECT CAST(invariant AS INTEGER) AS invariant, code, ids FROM named")
def edit_check(spark, sf):
    broken, signs = _broken(spark, sf)
    edited = broken.where("ord % 50 < 2").withColumns({"support": F.lit("conditional"), "question": F.lit(None).cast("string")})
    return ingestion.edit_breaches(broken, edited, signs).select("invariant", "code", F.array_join("device_ids", ",").alias("ids"))
