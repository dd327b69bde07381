"""Queries over the catalogue operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import matching, rules, text
from quern.operators import catalogue as cat
from quern.operators.matching import with_similarities
from quern.plans.inputs import DEVICES, VOTES, devices, table, votes
from quern.sources import csv
from quern.streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SYNONYMS = {"small": ["s"], "large": ["l"], "hot": ["heat", "proof"], "gizmo": ["gadget"]}
STOP = ["old", "new"]
CYRILLIC = {"a": "а", "e": "е", "o": "о", "t": "т", "n": "н", "r": "р", "h": "х"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-‐‑‒–—_./\\''"`‘’“”,]+', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS normalized FROM documents""")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalise(F.col("text")).alias("normalized"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_brand), '[^\p{L}\p{N}\s]', '', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '\s+', ' ', 'g')) AS brand FROM part""")
def normalize_part_brand(spark, sf):
    brand = text.collapse_spaces(text.split_letters_digits(text.strip_punctuation(F.lower("p_brand"))))
    return table(spark, sf, "part").select("p_partkey", brand.alias("brand"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(replace(replace(lower(p_name), 'o', '0'), 'i', CAST(p_size % 10 AS VARCHAR)) || ' ' || CAST(p_size AS VARCHAR) || 'l', ' '),
  lambda w: CASE WHEN regexp_full_match(w, '[0-9l]*l[0-9l]*') THEN replace(w, 'l', '1') WHEN regexp_full_match(w, '[a-z0]*0[a-z0]*') THEN replace(w, '0', 'o') ELSE w END), ' ') AS repaired FROM part""")
def lookalike_repair(spark, sf):
    dirty = F.concat(F.replace(F.replace(F.lower("p_name"), F.lit("o"), F.lit("0")), F.lit("i"), (F.col("p_size") % 10).cast("string")), F.lit(" "), F.col("p_size").cast("string"), F.lit("l"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.repair_lookalikes(F.split(dirty, " ")), " ").alias("repaired"))


@query("""SELECT p_partkey, array_to_string(flatten(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN ['s'] WHEN 'large' THEN ['l'] WHEN 'hot' THEN ['heat', 'proof'] WHEN 'gizmo' THEN ['gadget'] ELSE [w] END)), ' ') AS expanded FROM part""")
def synonym_expand(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.expand_synonyms(F.split("p_name", " "), SYNONYMS), " ").alias("expanded"))


@query("SELECT doc_id, translate(lower(text), 'aeotnrh', 'аеотнрх') AS cyrillic FROM documents")
def transliterate_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.transliterate(F.lower("text"), CYRILLIC).alias("cyrillic"))


ATTRIBUTES = {"storage": ["64 gb", "128gb", "1-tb"], "network": ["5g", "lte"], "dual_sim": ["dual sim", "2sim"], "color": ["red", "blue", "hot pink"]}


@query("""WITH RECURSIVE w AS (SELECT p_partkey, string_split(p_name || CASE p_partkey % 5 WHEN 0 THEN ' 64 GB red' WHEN 1 THEN ' dual SIM 128gb' WHEN 2 THEN ' hot pink 5G' WHEN 3 THEN ' 64 lte blue' ELSE '' END || CASE WHEN p_size >= 26 THEN ' ' || (2000 + p_size) ELSE ' 1999' END, ' ') AS words FROM part),
keyed AS (SELECT p_partkey, words, i, lower(words[i]) AS one, lower(words[i] || words[i + 1]) AS two FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM w)),
kinds AS (SELECT *, CASE WHEN two IN ('64gb', '128gb', '1tb') THEN 'storage' WHEN two IN ('5g', 'lte') THEN 'network' WHEN two IN ('dualsim', '2sim') THEN 'dual' WHEN two IN ('red', 'blue', 'hotpink') THEN 'color' END AS k2,
  CASE WHEN one IN ('64gb', '128gb', '1tb') THEN 'storage' WHEN one IN ('5g', 'lte') THEN 'network' WHEN one IN ('dualsim', '2sim') THEN 'dual' WHEN one IN ('red', 'blue', 'hotpink') THEN 'color' WHEN regexp_full_match(one, '20[0-9][0-9]') THEN 'year' END AS k1 FROM keyed),
walk AS (SELECT p_partkey, 1 AS i FROM w UNION ALL SELECT k.p_partkey, k.i + CASE WHEN k.k2 IS NOT NULL THEN 2 ELSE 1 END FROM walk JOIN kinds k ON k.p_partkey = walk.p_partkey AND k.i = walk.i),
seen AS (SELECT k.p_partkey, k.i, coalesce(k2, k1) AS kind, CASE WHEN k2 IS NOT NULL THEN two ELSE one END AS value, words[k.i] AS word FROM walk JOIN kinds k ON k.p_partkey = walk.p_partkey AND k.i = walk.i)
SELECT p_partkey, arg_max(value, i) FILTER (kind = 'storage') AS storage, arg_max(value, i) FILTER (kind = 'network') AS network, coalesce(bool_or(kind = 'dual'), false) AS dual_sim, arg_max(value, i) FILTER (kind = 'color') AS color,
  CAST(arg_max(value, i) FILTER (kind = 'year') AS INTEGER) AS year, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (kind IS NULL), '') AS rest FROM seen GROUP BY p_partkey""")
def attribute_extract(spark, sf):
    k = F.col("p_partkey") % 5
    more = F.when(k == 0, "64 GB red").when(k == 1, "dual SIM 128gb").when(k == 2, "hot pink 5G").when(k == 3, "64 lte blue")
    words = F.split(F.concat_ws(" ", "p_name", more, F.when(F.col("p_size") >= 26, (2000 + F.col("p_size")).cast("string")).otherwise("1999")), " ")
    found = table(spark, sf, "part").select("p_partkey", text.extract_attributes(words, ATTRIBUTES).alias("a"))
    return found.select("p_partkey", *[F.col(f"a.{c}") for c in ("storage", "network", "dual_sim", "color", "year")], F.array_join("a.rest", " ").alias("rest"))


NAME_PAIRS = """WITH names AS (SELECT DISTINCT p_name AS n FROM part),
grams AS (SELECT n, '  ' || lower(n) || '  ' AS p FROM names),
every AS (SELECT n, substr(p, CAST(i AS BIGINT), 3) AS g FROM grams, unnest(range(1, length(p) - 1)) AS t(i)), ex AS (SELECT DISTINCT n, g FROM every),
pairs AS (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM every a JOIN ex b ON a.g = b.g AND a.n < b.n GROUP BY 1, 2),
twins AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM ex a JOIN ex b ON a.g = b.g AND a.n < b.n GROUP BY 1, 2)"""


def _pairs(spark, sf):
    """Pairs of different names that share a trigram."""
    names = table(spark, sf, "part").select("p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    return cat.shared_trigrams(a, b, "a", "b", F.col("a"), F.col("b")).where("a < b")


@query(NAME_PAIRS + " SELECT a, b, shared FROM pairs")
def trigram_candidates(spark, sf):
    return _pairs(spark, sf)


@query(NAME_PAIRS + ", sizes AS (SELECT n, count(*) AS c FROM ex GROUP BY n) SELECT a, b, round(common / (x.c + y.c - common), 9) AS jaccard FROM twins JOIN sizes x ON x.n = a JOIN sizes y ON y.n = b")
def trigram_jaccard(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(text.jaccard(text.trigrams(F.col("a")), text.trigrams(F.col("b"))), 9).alias("jaccard"))


@query()
def edit_similarity(spark, sf):
    return _pairs(spark, sf).select("a", "b", text.osa_distance(F.col("a"), F.col("b")).alias("distance"), F.round(text.edit_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query()
def jaro_winkler(spark, sf):
    return _pairs(spark, sf).select("a", "b", F.round(text.jaro(F.col("a"), F.col("b")), 9).alias("jaro"), F.round(text.jaro_winkler(F.col("a"), F.col("b")), 9).alias("jaro_winkler"))


@query("""WITH keys AS (SELECT upper(trim('sm-' || CAST(p_partkey % 1500 AS VARCHAR))) AS key, p_partkey FROM part),
own AS (SELECT key, min(p_partkey) AS p_partkey FROM keys GROUP BY key HAVING count(DISTINCT p_partkey) = 1)
SELECT l_orderkey, l_linenumber, l_partkey, own.p_partkey AS device FROM lineitem JOIN own ON own.key = 'SM-' || CAST(l_partkey AS VARCHAR)""")
def exact_code_join(spark, sf):
    own = cat.unique_keys(table(spark, sf, "part"), F.upper(F.trim(F.concat(F.lit("sm-"), (F.col("p_partkey") % 1500).cast("string")))), "p_partkey")
    asked = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("SM-"), F.col("l_partkey").cast("string")).alias("key"))
    return asked.join(own, "key").select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_partkey").alias("device"))


@query("SELECT lower(trim(p_name)) AS key, count(DISTINCT p_partkey) AS owners FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def alias_collisions(spark, sf):
    return cat.collisions(table(spark, sf, "part"), F.lower(F.trim("p_name")), "p_partkey")


@query(f"""WITH {DEVICES}, code AS (SELECT code AS key, min(id) AS id FROM devices GROUP BY code HAVING count(*) = 1),
alias AS (SELECT brand || ' ' || name || ' ' || generation AS key, min(id) AS id FROM devices GROUP BY 1 HAVING count(*) = 1)
SELECT d.id, coalesce(c.id, a.id) AS found, CASE WHEN c.id IS NOT NULL THEN 'code' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'none' END AS method
FROM devices d LEFT JOIN code c ON c.key = d.code LEFT JOIN alias a ON a.key = d.brand || ' ' || d.name || ' ' || d.generation""")
def fallback_join(spark, sf):
    d = devices(spark, sf)
    alias = F.concat_ws(" ", "brand", "name", F.col("generation").cast("string"))
    code = cat.unique_keys(d, F.col("code"), "id").select(F.col("key").alias("code"), F.col("id").alias("by_code"))
    other = cat.unique_keys(d, alias, "id").select(F.col("key").alias("alias"), F.col("id").alias("by_alias"))
    j = d.select("id", "code", alias.alias("alias")).join(code, "code", "left").join(other, "alias", "left")
    return j.select("id", F.coalesce("by_code", "by_alias").alias("found"), F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_alias").isNotNull(), "alias").otherwise("none").alias("method"))


@query(f"WITH {DEVICES}, n AS (SELECT brand, family, generation, count(*) AS n, min(id) AS first_id FROM devices GROUP BY 1, 2, 3) SELECT d.id, n.n AS members, n.first_id FROM devices d JOIN n USING (brand, family, generation)")
def self_join_expand(spark, sf):
    d = devices(spark, sf)
    groups = d.groupBy("brand", "family", "generation").agg(F.count("*").alias("members"), F.min("id").alias("first_id"))
    return d.join(groups, ["brand", "family", "generation"]).select("id", "members", "first_id")


@query(f"WITH {DEVICES}, v AS (SELECT DISTINCT event_type, 1 + length(event_type) * 3 AS v FROM events) SELECT event_type, count(*) AS n, min(id) AS first_id FROM v, devices WHERE generation <= v AND v <= generation + 4 GROUP BY event_type")
def version_range_join(spark, sf):
    # Versions are dealt to whole numbers, so the interval join is an equality join on the numbers a range covers.
    d = devices(spark, sf).select("id", F.col("generation").alias("low"), (F.col("generation") + 4).alias("high"), F.explode(F.sequence("generation", F.col("generation") + 4)).alias("major"))
    v = table(spark, sf, "events").select("event_type").distinct().withColumn("major", 1 + F.length("event_type") * 3)
    inside = rules.in_version_range(F.concat(F.col("major").cast("string"), F.lit(".0")), F.col("low").cast("string"), F.col("high").cast("string"))
    return v.join(d, "major").where(inside).groupBy("event_type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""SELECT c_custkey, c_name, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN n_nationkey % 2 = 0 THEN 'NATION' ELSE c_mktsegment END AS c_mktsegment
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0""")
def override_merge(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    patch = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.array(F.lit("c_acctbal"), F.lit("c_mktsegment")).alias("set"), F.lit(None).cast("double").alias("c_acctbal"), F.lit("NATION").alias("c_mktsegment"))
    return cat.merge_override(base, patch, "key", ["c_acctbal", "c_mktsegment"]).drop("key").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_join(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 200000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""WITH a AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))) AS f, list_sort(list_distinct(list(o_orderpriority) FILTER (o_totalprice > 300000))) AS p FROM orders GROUP BY 1),
b AS (SELECT o_custkey, coalesce(f, []) AS f, coalesce(p, []) AS p FROM a)
SELECT o_custkey, array_to_string(list_sort(CASE WHEN len(f) = 0 THEN p WHEN len(list_intersect(f, p)) = 0 THEN f ELSE list_intersect(f, p) END), ',') AS chosen FROM b""")
def semi_join_fallback(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))).alias("f"), F.array_sort(F.collect_set(F.when(F.col("o_totalprice") > 300000, F.col("o_orderpriority")))).alias("p"))
    both = F.array_intersect("f", "p")
    chosen = F.when(F.size("f") == 0, F.col("p")).when(F.size(both) == 0, F.col("f")).otherwise(both)
    return o.select("o_custkey", F.array_join(F.array_sort(chosen), ",").alias("chosen"))


DIFF = f"""WITH {DEVICES}, o AS (SELECT id, support, confidence FROM devices WHERE id % 7 <> 0),
n AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'conditional' ELSE support END AS support, confidence FROM devices WHERE id % 5 <> 0)"""


def _halves(spark, sf):
    d = devices(spark, sf).select("id", "support", "confidence")
    return d.where("id % 7 <> 0"), d.where("id % 5 <> 0").withColumn("support", F.when(F.col("id") % 11 == 0, "conditional").otherwise(F.col("support")))


@query(DIFF + """ SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.support <> n.support OR o.confidence <> n.confidence""")
def snapshot_diff(spark, sf):
    return cat.snapshot_diff(*_halves(spark, sf), "id", ["support", "confidence"])


@query(DIFF + " SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN 1 ELSE 2 END AS created, coalesce(n.support, o.support) AS support FROM o FULL JOIN n ON o.id = n.id")
def keyed_upsert(spark, sf):
    o, n = _halves(spark, sf)
    return cat.upsert(o.select("id", F.lit(1).alias("created"), "support"), n.select("id", F.lit(2).alias("created"), "support"), "id", "created")


CONSENSUS = f"""WITH {VOTES}, n AS (SELECT l_partkey, count_if(support = 'supported')::BIGINT AS y, count_if(support = 'not_supported')::BIGINT AS x, count_if(support = 'conditional')::BIGINT AS m FROM votes GROUP BY 1),
o AS (SELECT *, y + x + m AS t, CASE WHEN y + x + m = 0 THEN 'no-data' WHEN y + x + m = 1 THEN 'single-source' WHEN (y > 0)::INT + (x > 0)::INT + (m > 0)::INT = 1 THEN 'unanimous' WHEN m > 0 THEN 'caution-rule' ELSE 'quarantined' END AS outcome FROM n)"""


@query(CONSENSUS + " SELECT l_partkey, outcome, CASE WHEN outcome IN ('single-source', 'unanimous') THEN CASE WHEN y > 0 THEN 'supported' WHEN x > 0 THEN 'not_supported' ELSE 'conditional' END WHEN outcome = 'caution-rule' THEN 'conditional' END AS status, t AS agreement_count FROM o")
def consensus(spark, sf):
    first = cat.one_per_source(votes(spark, sf), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])
    return cat.consensus(first, "l_partkey", "support")


@query("""WITH v AS (SELECT l_partkey, l_shipdate::DATE - DATE '1990-01-01' AS d, year(l_shipdate) AS y FROM lineitem), c AS (SELECT l_partkey, y, count(*) AS n FROM v GROUP BY 1, 2),
m AS (SELECT l_partkey, max(n) AS n FROM c GROUP BY 1)
SELECT m.l_partkey, CASE WHEN count(*) = 1 THEN CAST(min(y) AS INTEGER) END AS y FROM m JOIN c ON c.l_partkey = m.l_partkey AND c.n = m.n GROUP BY 1""")
def majority_vote(spark, sf):
    return cat.majority(table(spark, sf, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y")), "l_partkey", "y")


@query(f"WITH {VOTES} SELECT l_partkey, CASE WHEN min(support) = max(support) THEN min(support) ELSE 'mixed' END AS status, count(DISTINCT l_suppkey) AS sources FROM votes GROUP BY 1")
def set_consensus(spark, sf):
    first = cat.one_per_source(votes(spark, sf), "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"])
    return first.groupBy("l_partkey").agg(cat.set_consensus(F.col("support")).alias("status"), F.count("*").alias("sources"))


@query(f"""WITH {DEVICES}, g AS (SELECT brand, family, count(*) AS n, CASE WHEN min(support) = max(support) THEN min(support) ELSE 'mixed' END AS s, bool_and(confidence = 'verified') AS v FROM devices WHERE confidence IN ('verified', 'derived') GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT brand, family, n AS records, CASE WHEN v THEN 'verified' ELSE 'derived' END AS confidence, CASE WHEN s = 'mixed' OR (s = 'not_supported' AND NOT v) THEN 'clarification_required' ELSE s END AS status FROM g""")
def family_having(spark, sf):
    d = devices(spark, sf).where(F.col("confidence").isin("verified", "derived"))
    g = d.groupBy("brand", "family").agg(F.count("*").alias("records"), cat.set_consensus(F.col("support")).alias("s"), F.bool_and(F.col("confidence") == "verified").alias("v")).where("records >= 3")
    return g.select("brand", "family", "records", F.when(F.col("v"), "verified").otherwise("derived").alias("confidence"), rules.family_rule(F.col("s"), F.col("v")).alias("status"))


@query(f"""WITH {DEVICES}, s AS (SELECT family, CASE WHEN confidence IN ('quarantined', 'unverified') THEN 'clarification_required' WHEN support <> 'conditional' THEN support WHEN generation < 10 THEN 'not_supported' ELSE 'supported' END AS s FROM devices)
SELECT family, count(*) AS n, CASE WHEN min(s) <> max(s) THEN 'disagree' WHEN min(s) = 'clarification_required' THEN 'agree-on-clarification' ELSE min(s) END AS status FROM s GROUP BY 1""")
def group_status(spark, sf):
    d = devices(spark, sf)
    conditions = F.array(F.struct(F.lit("osVersion").alias("scope"), F.lit("10").alias("value"), F.lit("not_supported").alias("support")))
    s = rules.confidence_gate(rules.resolve_conditions(F.col("support"), conditions, F.lit(None).cast("string"), F.col("generation").cast("string")), F.col("confidence"))
    g = d.select("family", s.alias("s")).groupBy("family").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
    return g.select("family", "n", F.when(F.col("a") != F.col("b"), "disagree").when(F.col("a") == rules.ASK, "agree-on-clarification").otherwise(F.col("a")).alias("status"))


#: Conditions by id: null, none, a region, a version, both, and one whose version is no number; regions and versions are sometimes unknown.
CONTEXT = """ctx AS (SELECT *, CASE WHEN id % 4 <> 0 THEN ' ' || brand END AS region, CASE WHEN id % 5 <> 0 THEN generation || '.' || (id % 20) END AS version,
  CASE WHEN id % 7 IN (2, 4) THEN 'BRAND#' || (id % 26) END AS region_rule, CASE id % 7 WHEN 3 THEN '12.9' WHEN 4 THEN '30.0.1' WHEN 5 THEN 'beta' END AS version_rule FROM devices)"""


@query(f"""WITH {DEVICES}, {CONTEXT}, v AS (SELECT *, CASE WHEN version IS NULL OR version_rule IS NULL OR version_rule = 'beta' THEN false ELSE
    list_transform(string_split(version || '.0', '.'), lambda x: CAST(x AS INTEGER)) < list_resize(list_transform(string_split(version_rule, '.'), lambda x: CAST(x AS INTEGER)), 3, 0) END AS older FROM ctx)
SELECT id, CASE WHEN support <> 'conditional' THEN support WHEN region_rule IS NULL AND version_rule IS NULL THEN 'clarification_required'
  WHEN upper(trim(region)) = region_rule THEN 'not_supported' WHEN older THEN 'not_supported'
  WHEN (region_rule IS NOT NULL AND region IS NULL) OR (version_rule IS NOT NULL AND version IS NULL) THEN 'clarification_required' ELSE 'supported' END AS status FROM v""")
def condition_resolve(spark, sf):
    d = devices(spark, sf)
    k, n = F.col("id") % 7, F.col("id")
    row = lambda s, v: F.struct(F.lit(s).alias("scope"), v.alias("value"), F.lit("not_supported").alias("support"))
    region_rule, none = F.concat(F.lit("brand#"), (n % 26).cast("string"), F.lit(" ")), F.array().cast("array<struct<scope:string,value:string,support:string>>")
    conditions = F.when(k == 1, none).when(k == 2, F.array(row("region", region_rule))).when(k == 3, F.array(row("osVersion", F.lit("12.9")))).when(k == 4, F.array(row("region", region_rule), row("osVersion", F.lit("30.0.1")))).when(k == 5, F.array(row("osVersion", F.lit("beta"))))
    region, version = F.when(n % 4 != 0, F.concat(F.lit(" "), "brand")), F.when(n % 5 != 0, F.concat(F.col("generation").cast("string"), F.lit("."), (n % 20).cast("string")))
    return d.select("id", rules.resolve_conditions(F.col("support"), conditions, region, version).alias("status"))


@query(f"WITH {DEVICES} SELECT id, CASE WHEN confidence IN ('quarantined', 'unverified') THEN 'clarification_required' ELSE support END AS status, CASE WHEN confidence IN ('quarantined', 'derived') THEN 'clarification_required' ELSE support END AS strict FROM devices")
def confidence_gate(spark, sf):
    s, c = F.col("support"), F.col("confidence")
    return devices(spark, sf).select("id", rules.confidence_gate(s, c).alias("status"), rules.confidence_gate(s, c, derived=False, unverified=True).alias("strict"))


FAMILY = "CASE id % 5 WHEN 0 THEN 'iphone' WHEN 1 THEN 'iphone-se' WHEN 2 THEN 'iphone-x' WHEN 3 THEN 'iphone-xr' ELSE family END"


@query(f"""WITH {DEVICES}, f AS (SELECT id, generation, {FAMILY} AS family FROM devices) SELECT id, CASE family WHEN 'iphone-x' THEN 'not_supported' WHEN 'iphone-xr' THEN 'supported'
WHEN 'iphone-se' THEN CASE WHEN generation >= 2 THEN 'supported' ELSE 'not_supported' END WHEN 'iphone' THEN CASE WHEN generation > 8 THEN 'supported' ELSE 'not_supported' END ELSE 'unknown' END AS status FROM f""")
def generation_rule(spark, sf):
    return devices(spark, sf).select("id", rules.generation_rule(F.expr(FAMILY), F.col("generation")).alias("status"))


@query(f"""WITH {DEVICES}, k AS (SELECT CAST(id AS VARCHAR) || ':' || support AS k FROM devices), g AS (SELECT substr(md5(k), 1, 4) AS g, sha256(string_agg(k, '|' ORDER BY k)) AS h, count(*) AS n FROM k GROUP BY 1)
SELECT substr(sha256(string_agg(h, '|' ORDER BY g)), 1, 12) AS version, CAST(sum(n) AS BIGINT) AS n FROM g""")
def catalog_fingerprint(spark, sf):
    return cat.fingerprint(devices(spark, sf).select(F.concat_ws(":", F.col("id").cast("string"), "support").alias("k")), "k")


@query(f"WITH {DEVICES} SELECT brand, confidence, count(*) AS n FROM devices GROUP BY GROUPING SETS ((brand), (confidence), ())")
def stats_grouping_sets(spark, sf):
    d = devices(spark, sf)
    return d.groupingSets([["brand"], ["confidence"], []], "brand", "confidence").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS total, count_if(value > 50)::BIGINT AS correct, count_if(value <= 1)::BIGINT AS false_positive, round(100.0 * count_if(value > 50) / count(*), 1) AS percent FROM events GROUP BY ROLLUP (event_type)")
def rollup_metrics(spark, sf):
    return table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("correct"), F.count_if(F.col("value") <= 1).alias("false_positive"), F.round(F.lit(100.0) * F.count_if(F.col("value") > 50) / F.count("*"), 1).alias("percent"))


@query(f"WITH {DEVICES} SELECT brand, count(*) AS n, min(name) AS first_name FROM devices WHERE confidence <> 'quarantined' GROUP BY brand")
def brand_list(spark, sf):
    return devices(spark, sf).where("confidence <> 'quarantined'").groupBy("brand").agg(F.count("*").alias("n"), F.min("name").alias("first_name")).orderBy(F.collate("brand", "UNICODE"))


@query(f"WITH {DEVICES} SELECT id, brand, name FROM devices WHERE confidence <> 'quarantined' ORDER BY brand, name, id LIMIT 20 OFFSET 40")
def paged_list(spark, sf):
    return devices(spark, sf).where("confidence <> 'quarantined'").select("id", "brand", "name").orderBy("brand", "name", "id").offset(40).limit(20)


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, sf):
    return cat.top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(f"WITH {DEVICES} SELECT id, name FROM devices WHERE contains(lower(name), 'bolt') OR contains(brand, '#17') OR contains(lower(code), '-99') ORDER BY id LIMIT 30")
def substring_search(spark, sf):
    d = devices(spark, sf)
    return d.where(F.contains(F.lower("name"), F.lit("bolt")) | F.contains("brand", F.lit("#17")) | F.contains(F.lower("code"), F.lit("-99"))).select("id", "name").orderBy("id").limit(30)


@query(f"WITH {DEVICES} SELECT id, CASE WHEN regexp_matches(code, '^SM-1') THEN 'alpha' WHEN regexp_matches(code, '^SM-[0-9]5') THEN 'beta' END AS guess, CASE WHEN id % 4 = 0 AND brand = 'brand#1' THEN 'eu' WHEN id % 4 = 1 AND brand = 'brand#2' THEN 'us' ELSE 'clarification_required' END AS region FROM devices")
def code_lookups(spark, sf):
    d = devices(spark, sf)
    suffixes = spark.createDataFrame([("brand#1", 0, "eu"), ("brand#2", 1, "us")], "brand string, suffix int, region string")
    guess = F.coalesce(*[F.when(F.col("code").rlike(p), b) for b, p in (("alpha", "^SM-1"), ("beta", "^SM-[0-9]5"))])
    j = d.withColumn("suffix", (F.col("id") % 4).cast("int")).join(F.broadcast(suffixes), ["brand", "suffix"], "left")  # two rows
    return j.select("id", guess.alias("guess"), F.coalesce("region", F.lit(rules.ASK)).alias("region"))


@query(f"""WITH {DEVICES}, r AS (SELECT id, CASE WHEN family NOT IN ('bolt', 'gear', 'widget', 'ring') THEN 'UNKNOWN_FAMILY' WHEN generation < 3 THEN 'YEAR_INVALID' WHEN support = 'conditional' AND id % 3 = 0 THEN 'CONDITION_MISSING' WHEN confidence = 'quarantined' THEN 'LOW_CONFIDENCE' END AS code FROM devices)
SELECT code, count(*) AS n, min(id) AS first_id FROM r GROUP BY code""")
def validate_rows(spark, sf):
    checks = [(~F.col("family").isin("bolt", "gear", "widget", "ring"), "UNKNOWN_FAMILY"), (F.col("generation") < 3, "YEAR_INVALID"), ((F.col("support") == "conditional") & (F.col("id") % 3 == 0), "CONDITION_MISSING"), (F.col("confidence") == "quarantined", "LOW_CONFIDENCE")]
    first = F.coalesce(*[F.when(c, F.lit(code)) for c, code in checks])
    return devices(spark, sf).select("id", first.alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""WITH {DEVICES}, c AS (SELECT code FROM devices GROUP BY code HAVING count(*) > 1), a AS (SELECT name, brand, generation FROM devices GROUP BY 1, 2, 3 HAVING min(support) <> max(support)),
v AS (SELECT id, 'CODE_SHARED' AS violation FROM devices WHERE code IN (SELECT code FROM c) UNION ALL SELECT d.id, 'ALIAS_STATUS' FROM devices d JOIN a USING (name, brand, generation) UNION ALL SELECT id, 'CONDITIONS_MISSING' FROM devices WHERE support = 'conditional' AND generation = 1)
SELECT id, violation FROM v""")
def invariants(spark, sf):
    d = devices(spark, sf)
    shared = d.join(cat.collisions(d, F.col("code"), "id").select(F.col("key").alias("code")), "code", "left_semi").select("id", F.lit("CODE_SHARED").alias("violation"))
    mixed = d.groupBy("name", "brand", "generation").agg(cat.set_consensus(F.col("support")).alias("s")).where("s = 'mixed'")
    alias = d.join(mixed, ["name", "brand", "generation"], "left_semi").select("id", F.lit("ALIAS_STATUS").alias("violation"))
    missing = d.where("support = 'conditional' AND generation = 1").select("id", F.lit("CONDITIONS_MISSING").alias("violation"))
    return shared.unionByName(alias).unionByName(missing)


@query("""SELECT user_id, event_type, count(*) AS occurrences, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS last_seen_us, arg_max(event_id, (ts, event_id)) AS payload FROM events GROUP BY 1, 2""")
def task_upsert(spark, sf):
    t = tasks.count_tasks(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id")
    return t.select("user_id", "event_type", "occurrences", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_seen_us"), "payload")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY")
def ttl_filter(spark, sf):
    return tasks.within_retention(table(spark, sf, "events"), "ts", F.expr("timestamp_ntz'2024-01-31 00:00:00'"), 10).select("event_id", "user_id")


@query('''SELECT p_partkey, p_name AS f0, p_brand || ',"x"' AS f1, p_type AS f2, CAST(p_size AS VARCHAR) AS f3, CAST(4 AS INTEGER) AS n FROM part''')
def csv_tokenize(spark, sf):
    p = table(spark, sf, "part")
    line = F.concat("p_name", F.lit(', "'), "p_brand", F.lit(',""x""" ,'), "p_type", F.lit(" , "), F.col("p_size").cast("string"))
    f = csv.tokenise(line)
    return p.select("p_partkey", *[F.get(f, F.lit(i)).alias(f"f{i}") for i in range(4)], F.size(f).alias("n"))


@query("""WITH d AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [p_brand, p_type, p_size::VARCHAR, 'high', 'note'] WHEN 1 THEN list_concat([p_brand, p_type, p_size::VARCHAR, 'high', 'note'], list_transform(range(p_partkey % 7 + 1), lambda x: 'tail'))
  WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN [p_brand, p_type, p_size::VARCHAR, 'high'] ELSE [p_brand, p_size::VARCHAR, 'high'] END ELSE [p_type, p_brand, p_size::VARCHAR, 'high', 'note', 'note'] END AS f FROM part),
c AS (SELECT p_partkey, list_transform(range(5), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN '' ELSE f[i + 1 - bit_count(m & ((1 << i) - 1))] END) AS r FROM d, range(32) t(m) WHERE len(f) < 5 AND bit_count(m) = 5 - len(f) UNION ALL SELECT p_partkey, list_concat(f[1:4], [array_to_string(f[5:], ',')]) FROM d WHERE len(f) > 5),
v AS (SELECT DISTINCT p_partkey, r FROM c WHERE starts_with(r[1], 'Brand#') AND regexp_full_match(r[3], '[0-9]+') AND r[4] = 'high'),
o AS (SELECT p_partkey, count(DISTINCT r[1]) = 1 AND count(DISTINCT r[2]) = 1 AND count(DISTINCT r[3]) = 1 AS same, [CASE WHEN min(r[1]) = max(r[1]) THEN min(r[1]) ELSE '~' END, CASE WHEN min(r[2]) = max(r[2]) THEN min(r[2]) ELSE '~' END, CASE WHEN min(r[3]) = max(r[3]) THEN min(r[3]) ELSE '~' END, CASE WHEN min(r[4]) = max(r[4]) THEN min(r[4]) ELSE '~' END, CASE WHEN min(r[5]) = max(r[5]) THEN min(r[5]) ELSE '~' END] AS agreed FROM v GROUP BY 1)
SELECT p_partkey, CASE WHEN len(f) = 5 THEN 'exact' WHEN same IS NULL THEN 'unresolvable' WHEN NOT same THEN 'identity-ambiguous' ELSE 'recovered' END AS outcome, CASE WHEN len(f) = 5 THEN array_to_string(f, '|') WHEN same THEN array_to_string(agreed, '|') END AS fields FROM d LEFT JOIN o USING (p_partkey)""")
def csv_realign(spark, sf):
    p = table(spark, sf, "part")
    row = [F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string"), F.lit("high"), F.lit("note")]
    k = F.col("p_partkey") % 4
    wide = F.concat(F.array(*row), F.array_repeat(F.lit("tail"), (F.col("p_partkey") % 7).cast("int") + 1))
    few = F.when(F.col("p_partkey") % 8 == 2, F.array(row[0], row[1], row[2], row[3])).otherwise(F.array(row[0], row[2], row[3]))
    dirty = F.when(k == 0, F.array(*row)).when(k == 1, wide).when(k == 2, few).otherwise(F.array(row[1], row[0], row[2], row[3], row[4], row[4]))
    valid = lambda r: F.get(r, F.lit(0)).startswith("Brand#") & F.get(r, F.lit(2)).rlike("^[0-9]+$") & (F.get(r, F.lit(3)) == "high")
    out = csv.realign(dirty, 5, valid, [0, 1, 2])
    return p.select("p_partkey", out.alias("o")).select("p_partkey", "o.outcome", F.array_join("o.fields", "|", "~").alias("fields"))


@query(f"""WITH {DEVICES}, q AS (SELECT DISTINCT family, generation AS g FROM devices), s AS (SELECT q.family, q.g, d.id, CASE WHEN d.confidence = 'verified' THEN 0.9 ELSE 0.7 END + 0.1 * d.price / (d.price + 1000) AS score FROM q JOIN devices d ON d.family = q.family AND d.generation = q.g),
r AS (SELECT *, row_number() OVER (PARTITION BY family, g ORDER BY score DESC, id) AS rn, lead(score) OVER (PARTITION BY family, g ORDER BY score DESC, id) AS nx FROM s)
SELECT family || '-' || g AS query, id AS leader, round(score, 9) AS score, round(score - coalesce(nx, 0), 9) AS lead, CASE WHEN score < 0.8 THEN 'BELOW_THRESHOLD' WHEN score - coalesce(nx, 0) >= 0.05 THEN 'DETERMINED' ELSE 'GAP_TOO_SMALL' END AS outcome FROM r WHERE rn = 1""")
def match_decide(spark, sf):
    d = devices(spark, sf)
    q = d.select("family", "generation").distinct()
    score = F.when(F.col("confidence") == "verified", 0.9).otherwise(0.7) + F.lit(0.1) * F.col("price") / (F.col("price") + 1000)
    s = q.join(d, ["family", "generation"]).select(F.concat_ws("-", "family", F.col("generation").cast("string")).alias("query"), "id", score.alias("score"))
    return cat.decide(s, "query", "id", "score", 0.8, 0.05).select("query", "leader", F.round("score", 9).alias("score"), F.round("lead", 9).alias("lead"), "outcome")


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries made of a device of each (family, first word) with forms of their family, and the devices.

    A form is what devices have in common that differ in id, popularity and support alone, so queries meet as many rows as there are
    different forms, and each pair is compared once. Pairs: query, q, form, d (of popularity 0), the similarities and reason. Devices: form, popularity, support, id.
    """
    d = devices(spark, sf)
    some = lambda n: F.when(n % 4 == 0, F.array(F.lit("pro"))).when(n % 4 == 1, F.array(F.lit("a"))).when(n % 4 == 2, F.array(F.lit("pro"), F.lit("max"))).otherwise(F.array().cast("array<string>"))
    n = F.col("id")
    named = ["brand", "family", "generation", "modifiers"]
    items = d.select("id", "support", "brand", "family", "generation", some(n).alias("modifiers"), (n % 40).cast("double").alias("popularity")).withColumn("form", F.to_json(F.struct(*named)))
    forms = items.select("form", "family", F.struct(*named, F.lit(0.0).alias("popularity")).alias("d")).distinct()
    brand = F.when(n % 3 == 0, F.expr("left(brand, length(brand) - 1)")).when(n % 3 == 1, F.col("brand"))
    q = d.groupBy("family", "modifier").agg(F.min_by(F.struct("id", "brand", "generation"), "id").alias("_one")).select(F.concat_ws("-", "family", "modifier").alias("query"), "family", "_one.*")
    unparsed = F.when(n % 5 == 0, F.array(F.lit("x1"))).otherwise(F.array().cast("array<string>"))
    q = q.select("query", F.col("family"), F.struct(brand.alias("brand"), F.when(n % 4 != 3, F.col("family")).alias("family"), F.when(n % 2 == 0, F.col("generation")).alias("generation"), F.when(n % 7 < 3, some(n)).otherwise(F.array().cast("array<string>")).alias("modifiers"), unparsed.alias("unparsed")).alias("q"))
    known = [f"brand#{i}" for i in range(1, 26)]
    pairs = with_similarities(q.join(forms, "family"), known)
    pairs = pairs.withColumn("reason", matching.rejection(F.col("q"), F.col("d"), known, similar=F.col("similar"), resolved=F.col("resolved")))
    return pairs, items.select("form", "popularity", "support", "id")


@query()
def constraint_reject(spark, sf):
    pairs, items = _matched(spark, sf)
    forms = items.groupBy("form").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return pairs.join(forms, "form").groupBy("query", F.coalesce("reason", F.lit("PASS")).alias("reason")).agg(F.sum("n").alias("n"), F.min("id").alias("first_id"))


def _scored(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs that pass, each with the items (form, popularity and others) of its form, scored."""
    d = F.struct("d.brand", "d.family", "d.generation", "d.modifiers", "popularity")
    met = pairs.where("reason is null").join(items, "form").withColumn("d", d)
    parts = matching.score_parts(F.col("q"), F.col("d"), F.lit(None).cast("string"), similar=F.col("similar"), family=F.col("family_like"))
    return met.withColumn("score", matching.weighted_score(parts))


@query()
def score_rank(spark, sf):
    """Within a form a score grows with the popularity, so the k best of a query are among the k most popular of a form."""
    pairs, items = _matched(spark, sf)
    few = cat.top_k(items, ["form"], [F.desc("popularity"), F.asc("id")], 5).drop("rank")
    scored = _scored(pairs, few).select("query", "id", "score", "popularity")
    return cat.top_k(scored, ["query"], [F.desc("score"), F.desc("popularity"), F.asc("id")], 5).select("query", "id", "rank", F.round("score", 9).alias("score"))


@query()
def match_resolve(spark, sf):
    """Devices that differ in id alone are one row, which stands for n."""
    pairs, items = _matched(spark, sf)
    kinds = items.groupBy("form", "popularity", "support").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    narrower = matching.narrower(F.col("q"), F.col("d"), F.lit(None).cast("string"))
    scored = _scored(pairs, kinds).select("query", "id", "n", "support", "score", "popularity", (F.size("q.unparsed") == 0).alias("clear"), narrower.alias("narrow"))
    asked = devices(spark, sf).select(F.concat_ws("-", "family", "modifier").alias("query")).distinct()
    out = cat.decide(scored, "query", "id", "score", 0.72, 0.08, [F.desc("popularity")], "support", F.col("clear"), F.col("narrow"), asked, "n")
    return out.withColumns({"score": F.round("score", 9), "lead": F.round("lead", 9)})
