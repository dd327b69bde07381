"""Cases that reviews found, each against the query's SQL or a plain version."""

import glob
import os
from datetime import datetime

import duckdb

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quern.operators import detection as operators
from quern.operators import matching
from quern.plans import detection, search


def same_as_sql(spark, folder, name):
    """The rows of a query and of its SQL over the Parquet files of a folder, sorted."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    expected = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).select(columns).collect()]
    return sorted(got, key=repr), sorted(expected.fetchall(), key=repr)


def test_representative_of_rows_that_tie(spark, tmp_path):
    row = lambda part, supplier, flag, year: (part, supplier, 1, 1, datetime(year, 5, 1), 0.05, flag)
    rows = [r for part in range(40) for r in (row(part, 9, "A", 1999), row(part, 4, "N", 1997), row(part, 4, "A", 1998))]
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, l_shipdate timestamp, l_tax double, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, expected = same_as_sql(spark, tmp_path, "representative")
    assert got == expected


def _copies(spark, folder, times=3):
    """Parts, each several times under other keys that leave name, popularity and code classes as they are."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 24")
    more = spark.range(times).select((F.col("id") * 22800).alias("_more"))  # a multiple of 1900, 40 and 6
    parts.crossJoin(more).withColumn("p_partkey", F.col("p_partkey") + F.col("_more")).drop("_more").coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_counts_of_retrieval_make_no_pairs(spark, tmp_path):
    _copies(spark, tmp_path)
    asked, catalog = search._asked(spark, str(tmp_path)), search._catalog(spark, str(tmp_path))
    found = matching.retrieve(asked, catalog).groupBy("query", "reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("shared").alias("most_shared"), F.min("shared").alias("least_shared"))
    assert sorted(map(tuple, matching.retrieval_counts(asked, catalog).collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)


def test_devices_that_differ_in_id_alone_are_one_candidate(spark, tmp_path):
    _copies(spark, tmp_path)
    rows = matching.ranked(search._asked(spark, str(tmp_path)), search._catalog(spark, str(tmp_path)), shown=2).where("reason = 'MATCH_FUZZY_FAMILY'").select("id", "n", "members").collect()
    assert rows and all(r["n"] == 3 and r["members"] == [r["id"], r["id"] + 22800] for r in rows)


def test_unknown_codes_and_screens_without_answers(spark):
    sf = "/root/testdata/sf0.001"
    asked, answers = detection._asked(spark, sf), detection._answers(spark, sf)
    pairs = [
        (operators.met_unknown_codes(asked, detection.catalog(spark, sf), "event_id"), operators.unknown_codes(answers, "event_id")),
        (operators.met_unknown_screens(asked, detection.screens(spark, sf), "event_id"), operators.unknown_screens(answers, "event_id")),
    ]
    for got, expected in pairs:
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
