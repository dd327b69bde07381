"""Queries over whole files of damaged rows, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.inputs import table
from quern.plans.queries import query
from quern.sources import csv

COLUMNS = [("brand", True, None), ("marketing_name", True, None), ("esim_support", True, ["yes", "no", "conditional", "unknown"]), ("esim_conditions", False, None), ("confidence", True, ["high", "medium", "low"]), ("notes", False, None)]
HEADER = "'brand' || D || 'marketing_name' || D || 'esim_support' || D || 'esim_conditions' || D || 'confidence' || D || 'notes'"
#: A line per part, in files of 48 parts: every kind of damage, two delimiters, fences, prose and headers.
LINE = f"""CASE p_partkey % 12 WHEN 0 THEN '"' || p_name || D || ' x"' || D || ' YES ' || D || D || 'high' || D || '"say ""hi"" now"'
WHEN 1 THEN p_brand || D || p_name || D || 'conditional' || D || 'region:CN=no' || D || 'Low' || D || 'ok' WHEN 2 THEN p_brand || D || p_name || D || 'no' || D || D || 'medium'
WHEN 3 THEN p_brand || D || p_name || D || 'conditional' || D || 'high' || D || 'high' WHEN 4 THEN p_brand || D || p_name || D || 'no' || D || D || 'high' || D || 'a' || D || ' b'
WHEN 5 THEN p_brand || D || p_name || D || D || 'no' || D || D || 'high' || D WHEN 6 THEN p_brand || D || p_name || D || 'perhaps' WHEN 7 THEN 'Here is a list, of phones' WHEN 8 THEN '  ```csv'
WHEN 9 THEN {HEADER} WHEN 10 THEN '  ' ELSE p_brand || D || p_name || D || 'True' || D || D || 'low' || D END"""
FILE, D = "CAST(floor(p_partkey / 48.0) AS INTEGER)", "CASE WHEN CAST(floor(p_partkey / 48.0) AS INTEGER) % 3 = 1 THEN ';' ELSE ',' END"
FILES = f"""p AS (SELECT {FILE} AS file, {D} AS D, p_partkey, p_name, p_brand FROM part),
files AS (SELECT file, CASE WHEN file % 5 = 0 THEN chr(65279) ELSE '' END || CASE WHEN file % 4 > 0 THEN any_value({HEADER}) || chr(10) ELSE '' END || replace(array_to_string(list({LINE} ORDER BY p_partkey), chr(10)), chr(10), CASE WHEN file % 2 = 0 THEN chr(10) ELSE chr(13) || chr(10) END) AS text FROM p GROUP BY file),
numbered AS (SELECT file, starts_with(text, chr(65279)) AS bom, unnest(string_split_regex(ltrim(text, chr(65279)), '\\r\\n|\\n')) AS line, generate_subscripts(string_split_regex(ltrim(text, chr(65279)), '\\r\\n|\\n'), 1) AS n FROM files),
counted AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence, trim(line) = '' AS blank, regexp_replace(line, '"[^"]*"', '', 'g') AS bare FROM numbered),
heads AS (SELECT file, arg_min(bare, n) AS bare FROM counted WHERE NOT fence AND NOT blank GROUP BY file),
marks AS (SELECT file, CASE WHEN abs(length(bare) - length(replace(bare, ';', '')) - 5) < abs(length(bare) - length(replace(bare, ',', '')) - 5) THEN ';' ELSE ',' END AS d FROM heads),
told AS (SELECT c.*, d, length(bare) - length(replace(bare, d, '')) < 2 AS prose FROM counted c JOIN marks USING (file)),
split AS (SELECT file, n, line, d, list_transform(string_split(replace(regexp_replace(replace(line, '""', chr(2)), '"([^"]*)[' || d || ']([^"]*)"', '\\1' || chr(3) || '\\2', 'g'), '"', ''), d), lambda x: trim(replace(replace(x, chr(3), d), chr(2), '"'))) AS f FROM told WHERE NOT fence AND NOT blank AND NOT prose)"""


def part_files(spark, sf):
    """Files of 48 lines each, however many parts there are."""
    p = table(spark, sf, "part").select(F.expr(FILE).alias("file"), F.expr(D).alias("D"), "p_partkey", "p_name", "p_brand")
    lines = p.select("file", "p_partkey", F.expr(LINE).alias("line"), F.expr(HEADER).alias("head"))
    g = lines.groupBy("file").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("rows"))
    text = F.concat(F.when(F.col("file") % 5 == 0, "﻿").otherwise(""), F.when(F.col("file") % 4 > 0, F.concat("head", F.lit("\n"))).otherwise(""))
    body = F.when(F.col("file") % 2 == 0, F.array_join("rows.line", "\n")).otherwise(F.array_join("rows.line", "\r\n"))
    return g.select("file", F.concat(text, body).alias("text"))


@query(f"""WITH {FILES}, data AS (SELECT * FROM split WHERE NOT (list_contains(list_transform(f, lambda x: lower(x)), 'brand') AND list_contains(list_transform(f, lambda x: lower(x)), 'marketing_name') AND list_contains(list_transform(f, lambda x: lower(x)), 'esim_support'))),
tried AS (SELECT *, CASE len(f) WHEN 6 THEN [f] WHEN 5 THEN list_transform(range(0, 6), lambda i: list_concat(list_concat(f[1:i], ['']), f[i + 1:5]))
  WHEN 7 THEN list_concat([list_concat(f[1:5], [f[6] || ',' || f[7]])], list_transform(list_filter(range(0, 7), lambda i: f[i + 1] = ''), lambda i: list_concat(f[1:i], f[i + 2:7]))) ELSE [] END AS options FROM data),
good AS (SELECT *, CASE WHEN len(f) = 6 THEN options ELSE list_distinct(list_filter(options, lambda o: lower(o[3]) IN ('yes', 'no', 'conditional', 'unknown') AND lower(o[5]) IN ('high', 'medium', 'low'))) END AS valid FROM tried),
agreed AS (SELECT *, list_transform(range(1, 7), lambda i: CASE WHEN len(list_distinct(list_transform(valid, lambda o: o[i]))) = 1 THEN valid[1][i] END) AS r FROM good),
kept AS (SELECT *, len(valid) = 0 OR r[1] IS NULL OR r[2] IS NULL OR r[3] IS NULL AS bad FROM agreed),
named AS (SELECT file, n, line, f, bad, CASE WHEN bad THEN NULL ELSE CASE lower(r[3]) WHEN 'true' THEN 'yes' ELSE lower(r[3]) END END AS support, r FROM kept)
SELECT file, CAST(n AS INTEGER) AS line_number, line, CASE WHEN bad OR (support = 'conditional' AND len(f) <> 6 AND r[4] IS NULL) THEN 'FIELD_COUNT_MISMATCH' END AS code, len(f) <> 6 AND NOT bad AS realigned,
  CASE WHEN NOT bad THEN nullif(r[1], '') END AS brand, CASE WHEN NOT bad THEN nullif(r[2], '') END AS marketing_name, support AS esim_support, CASE WHEN NOT bad THEN nullif(r[4], '') END AS esim_conditions, CASE WHEN NOT bad THEN nullif(r[5], '') END AS confidence, CASE WHEN NOT bad THEN nullif(r[6], '') END AS notes FROM named""")
def csv_parse(spark, sf):
    return csv.parse(part_files(spark, sf), COLUMNS, csv.DEVICE_HEADER, ["brand", "marketing_name", "esim_support"], ("esim_support", "conditional", "esim_conditions"), csv.YES_NO)


@query(f"""WITH {FILES}, heads2 AS (SELECT file, n, lower(line) LIKE '%brand%marketing_name%esim_support%' AS head, row_number() OVER (PARTITION BY file ORDER BY n) AS k FROM split),
h AS (SELECT file, bool_or(head AND k = 1) AS leads, count(*) FILTER (head) AS heads FROM heads2 GROUP BY file),
t AS (SELECT file, bool_or(bom) AS bom, bool_or(fence) AS fence, any_value(d) = ';' AS semicolon, bool_or(NOT fence AND NOT blank AND prose) AS prose FROM told GROUP BY file)
SELECT t.file, concat_ws(',', CASE WHEN bom THEN 'BOM_STRIPPED' END, CASE WHEN fence THEN 'MARKDOWN_FENCE_STRIPPED' END, CASE WHEN semicolon THEN 'DELIMITER_SEMICOLON' END, CASE WHEN prose THEN 'PROSE_LINE_SKIPPED' END,
  CASE WHEN NOT leads THEN 'HEADER_MISSING' END, CASE WHEN heads > CAST(leads AS INTEGER) THEN 'REPEATED_HEADER_SKIPPED' END) AS notices FROM t LEFT JOIN h USING (file)""")
def csv_notices(spark, sf):
    return csv.format_notices(part_files(spark, sf), COLUMNS, csv.DEVICE_HEADER).select("file", F.array_join("notices", ",").alias("notices"))
