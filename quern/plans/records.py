"""Queries over checked records, signals read from JSON, and merged identities, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import identity
from quern.plans.inputs import table
from quern.plans.queries import query
from quern.plans.search import WORDS
from quern.sources import records
from quern.sources.records import Field

#: JSON lines of events, most of them damaged in some way.
LINE = """CASE event_id % 14 WHEN 0 THEN '{"id":"u' || user_id WHEN 1 THEN '[1,2]' WHEN 2 THEN '{"id":"u' || user_id || '","n":' || event_id || ',"tags":["a","b"]}' WHEN 3 THEN '{"id":"u' || user_id || '","n":"' || event_id || '","kind":"view","tags":[]}'
  WHEN 4 THEN '{"id":"u' || user_id || '","n":-' || event_id || ',"kind":"click","tags":["x"]}' WHEN 5 THEN '{"id":"u' || user_id || '","n":7,"kind":"other","tags":["x"]}' WHEN 6 THEN '{"id":"u' || user_id || '","n":8,"kind":"view","tags":[1,"x"]}'
  WHEN 7 THEN '{"id":"u' || user_id || '","n":9,"kind":"view","tags":["x"],"z":1,"more":{}}' WHEN 8 THEN '{"id":"","n":1.5,"kind":null,"tags":["1","2","3","4"]}' WHEN 9 THEN '{"id":null,"n":true,"kind":1,"tags":{"a":1}}' WHEN 10 THEN '' WHEN 11 THEN '{"kind":"' || event_type || '","tags":null,"id":"u' || user_id || '","n":' || user_id || '}'
  ELSE ' { "id" : "u' || user_id || '", "n":' || event_id || ',"kind":"' || event_type || '","tags":["' || event_type || '"]} ' END"""
TYPES = ["view", "signup", "error", "click", "purchase"]
FIELDS = [Field("id", shortest=1), Field("n", "int", low=0), Field("kind", allowed=TYPES), Field("tags", "strings", nullable=True, longest=3)]
_LINES = f"""lines AS (SELECT event_id, {LINE} AS t FROM events), j AS (SELECT *, CASE WHEN t <> '' AND json_valid(t) THEN t::JSON END AS v FROM lines),
p AS (SELECT *, json_type(v, '$.id') AS ti, json_type(v, '$.n') AS tn, json_type(v, '$.kind') AS tk, json_type(v, '$.tags') AS tt FROM j),
judged AS (SELECT event_id, v, CASE WHEN v IS NULL THEN ['json'] WHEN json_type(v) <> 'OBJECT' THEN ['object'] ELSE list_concat(list_filter([
  CASE WHEN ti IS NULL THEN 'missing:id' WHEN ti <> 'VARCHAR' THEN 'type:id' WHEN length(v ->> '$.id') < 1 THEN 'length:id' END,
  CASE WHEN tn IS NULL THEN 'missing:n' WHEN tn NOT IN ('UBIGINT', 'BIGINT') THEN 'type:n' WHEN CAST(v ->> '$.n' AS BIGINT) < 0 THEN 'range:n' END,
  CASE WHEN tk IS NULL THEN 'missing:kind' WHEN tk <> 'VARCHAR' THEN 'type:kind' WHEN (v ->> '$.kind') NOT IN ({", ".join(f"'{t}'" for t in TYPES)}) THEN 'value:kind' END,
  CASE WHEN tt IS NULL THEN 'missing:tags' WHEN tt = 'NULL' THEN NULL WHEN tt <> 'ARRAY' OR len(list_filter(json_extract(v, '$.tags[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'type:tags' WHEN json_array_length(v, '$.tags') > 3 THEN 'length:tags' END], lambda x: x IS NOT NULL),
  list_transform(list_sort(list_filter(json_keys(v), lambda k: k NOT IN ('id', 'n', 'kind', 'tags'))), lambda k: 'unknown:' || k)) END AS reasons FROM p)"""


def _checked(spark, sf, key=None):
    lines = table(spark, sf, "events").select("event_id", F.expr(LINE).alias("t"))
    return records.checked(lines, "t", FIELDS, ("event_id",), key, ("event_id",), closed=True)


@query(f"WITH {_LINES} SELECT event_id, array_to_string(reasons, '|') AS reasons FROM judged WHERE len(reasons) > 0")
def record_rejects(spark, sf):
    return _checked(spark, sf)[1].select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {_LINES}, good AS (SELECT event_id, v ->> '$.id' AS id, CAST(v ->> '$.n' AS BIGINT) AS n, v ->> '$.kind' AS kind, CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN array_to_string(json_extract_string(v, '$.tags[*]'), '|') END AS tags FROM judged WHERE len(reasons) = 0)
SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1""")
def record_check(spark, sf):
    return _checked(spark, sf, "id")[0].withColumn("tags", F.array_join("tags", "|"))


#: Signals as browsers send them, with parts that are missing, empty, of the wrong kind, or no numbers.
SENT = """CASE WHEN event_id % 17 = 0 THEN substr('{"userAgent":"cut off"}', 1, 5 + event_id % 12) ELSE '{"k":' || event_id || CASE event_id % 4 WHEN 0 THEN ',"userAgent":"agent ' || user_id || '"' WHEN 1 THEN ',"userAgent":7' WHEN 2 THEN ',"userAgent":null' ELSE '' END
  || CASE event_id % 5 WHEN 0 THEN ',"screen":{"width":' || (300 + event_id % 200) || '.5,"height":"tall","dpr":3}' WHEN 1 THEN ',"screen":{"width":"wide","dpr":null}' WHEN 2 THEN ',"screen":{}' WHEN 3 THEN ',"screen":[390,844]' ELSE ',"screen":{"width":-0.5,"availWidth":12.49,"dpr":2.25,"orientation":"portrait"}' END
  || CASE event_id % 6 WHEN 0 THEN ',"hardware":{"maxTouchPoints":1e400,"deviceMemory":8}' WHEN 1 THEN ',"hardware":{"maxTouchPoints":5}' WHEN 2 THEN ',"hardware":null' ELSE '' END
  || CASE event_id % 7 WHEN 0 THEN ',"uaData":{"platform":"Android","mobile":true,"model":"SM-' || user_id || '","brands":[{"brand":"Chrome","version":"1"},{"version":"2"},5]}' WHEN 1 THEN ',"uaData":{"mobile":"yes","brands":"none"}' WHEN 2 THEN ',"uaData":{"mobile":false,"brands":[]}' ELSE '' END || '}' END"""
_ROUNDED = lambda p: f"CASE WHEN json_type(v, '{p}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND isfinite(CAST(v ->> '{p}' AS DOUBLE)) THEN CAST(floor(CAST(v ->> '{p}' AS DOUBLE) + 0.5) AS BIGINT) END"
_NUMBER = lambda p: f"CASE WHEN json_type(v, '{p}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND isfinite(CAST(v ->> '{p}' AS DOUBLE)) THEN CAST(v ->> '{p}' AS DOUBLE) END"
_TEXT = lambda p: f"CASE WHEN json_type(v, '{p}') = 'VARCHAR' THEN v ->> '{p}' END"


@query(f"""WITH sent AS (SELECT event_id, {SENT} AS t FROM events), j AS (SELECT event_id, CASE WHEN json_valid(replace(t, '1e400', '"inf"')) THEN replace(t, '1e400', '"inf"')::JSON END AS v FROM sent),
r AS (SELECT event_id, v IS NOT NULL AS readable, {_TEXT('$.userAgent')} AS agent, {_ROUNDED('$.screen.width')} AS width, {_ROUNDED('$.screen.height')} AS height, {_ROUNDED('$.screen.availWidth')} AS avail, {_NUMBER('$.screen.dpr')} AS dpr, {_TEXT('$.screen.orientation')} AS orientation, {_ROUNDED('$.hardware.maxTouchPoints')} AS touch, {_NUMBER('$.hardware.deviceMemory')} AS memory,
  {_TEXT('$.uaData.platform')} AS platform, {_TEXT('$.uaData.model')} AS model, CASE WHEN json_type(v, '$.uaData.mobile') = 'BOOLEAN' THEN CAST(v ->> '$.uaData.mobile' AS BOOLEAN) END AS mobile, CASE WHEN json_type(v, '$.uaData.brands') = 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(v, '$.uaData.brands[*]'), lambda b: CASE WHEN json_type(b) = 'OBJECT' THEN b ->> '$.brand' END), lambda b: b IS NOT NULL), '|') END AS brands FROM j)
SELECT *, coalesce(width::VARCHAR, height::VARCHAR, avail::VARCHAR, dpr::VARCHAR, orientation) IS NOT NULL AS has_screen, touch IS NOT NULL OR memory IS NOT NULL AS has_hardware, coalesce(platform, model, mobile::VARCHAR, brands) IS NOT NULL AS has_ua_data FROM r""")
def signals_read(spark, sf):
    s = table(spark, sf, "events").select("event_id", records.signals(F.expr(SENT)).alias("s"))
    c = F.col
    return s.select(
        "event_id", c("s").isNotNull().alias("readable"), c("s.userAgent").alias("agent"), c("s.screen.width").alias("width"), c("s.screen.height").alias("height"), c("s.screen.availWidth").alias("avail"), c("s.screen.dpr").alias("dpr"), c("s.screen.orientation").alias("orientation"), c("s.hardware.maxTouchPoints").alias("touch"), c("s.hardware.deviceMemory").alias("memory"),
        c("s.uaData.platform").alias("platform"), c("s.uaData.model").alias("model"), c("s.uaData.mobile").alias("mobile"), F.array_join("s.uaData.brands", "|").alias("brands"), *[F.coalesce(c(f"s.{p}").isNotNull(), F.lit(False)).alias(n) for p, n in (("screen", "has_screen"), ("hardware", "has_hardware"), ("uaData", "has_ua_data"))],
    )


PARENTS, TITLES = {"redline": "acme", "bluebird": "acme"}, {"redline": "Redline", "bluebird": "Bluebird", "acme": "Acme"}
_NAMED = "CASE WHEN p_partkey % 3 = 0 THEN 'hot rod' ELSE p_name || ' ' || p_size END"
#: Rows of one line under its own brand and its parent's; a third of them are one name with a chain of codes.
ROWS = {
    "brand": "CASE WHEN p_partkey % 4 IN (0, 3) THEN 'redline' ELSE 'acme' END",
    "name": f"CASE p_partkey % 4 WHEN 0 THEN {_NAMED} WHEN 1 THEN ' REDLINE ' || upper({_NAMED}) WHEN 2 THEN {_NAMED} ELSE 'Redline ' || {_NAMED} END",
    "first": "CASE WHEN p_partkey % 3 = 0 THEN 'hub' || (p_partkey // 300) ELSE 'sm-' || (p_partkey % 700) END",
    "second": "CASE WHEN p_partkey % 3 = 0 THEN 'HUB' || (p_partkey // 300 + 1) WHEN p_partkey % 2 = 0 THEN 'SM-' || (p_partkey % 350) END",
}


@query(f"""WITH RECURSIVE r AS (SELECT p_partkey, 'd' || p_partkey AS id, {", ".join(f"{v} AS {k}" for k, v in ROWS.items())}, p_size FROM part),
i AS (SELECT *, CASE WHEN brand = 'redline' THEN CASE WHEN starts_with(name, 'Redline ') THEN substr(name, 9) ELSE trim(name) END WHEN starts_with(name, ' REDLINE ') THEN substr(name, 10) END AS rest FROM r),
k AS (SELECT DISTINCT p_partkey, lower(rest) || '|' || upper(c) AS key FROM (SELECT p_partkey, rest, unnest([first, second]) AS c FROM i WHERE rest IS NOT NULL) WHERE c IS NOT NULL),
low AS (SELECT key, min(p_partkey) AS m FROM k GROUP BY 1), e AS (SELECT DISTINCT p_partkey AS a, m AS b FROM k JOIN low USING (key) UNION SELECT DISTINCT m, p_partkey FROM k JOIN low USING (key)),
reach AS (SELECT p_partkey AS a, p_partkey AS b FROM i WHERE rest IS NOT NULL UNION SELECT e.b, reach.b FROM reach JOIN e ON e.a = reach.a),
c AS (SELECT a, min(b) AS root FROM reach GROUP BY 1), n AS (SELECT root, count(*) AS n FROM c GROUP BY 1),
f AS (SELECT c.a, i.rest FROM c JOIN n USING (root) JOIN i ON i.p_partkey = c.root WHERE n.n > 1)
SELECT r.p_partkey, CASE WHEN f.rest IS NULL THEN r.id ELSE 'redline-' || replace(lower(f.rest), ' ', '-') END AS id, CASE WHEN f.rest IS NULL THEN r.brand ELSE 'redline' END AS brand, CASE WHEN r.brand = 'redline' OR f.rest IS NOT NULL THEN 'Redline' ELSE 'Acme' END AS brand_title, coalesce(f.rest, r.name) AS name,
  CASE WHEN f.rest IS NULL THEN 'old' ELSE array_to_string(list_filter(string_split(lower(f.rest), ' '), lambda w: regexp_full_match(w, '[a-z]+') AND w NOT IN ('old', 'cold')), '-') END AS family, CASE WHEN f.rest IS NULL THEN p_size ELSE CAST(nullif(regexp_extract(f.rest, '[0-9]+'), '') AS INTEGER) END AS generation FROM r LEFT JOIN f ON f.a = r.p_partkey""")
def identity_merge(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("id"), *[F.expr(v.replace("p_partkey // 300", "p_partkey div 300")).alias(k) for k, v in ROWS.items()])
    rows = p.select("p_partkey", "id", "brand", "name", F.array_compact(F.array("first", "second")).alias("codes"), F.lit("old").alias("family"), F.col("p_size").alias("generation"), F.array().cast("array<string>").alias("modifiers"))
    return identity.merge_identities(rows, "p_partkey", PARENTS, TITLES, WORDS)[0].select("p_partkey", "id", "brand", "brand_title", "name", "family", "generation")
