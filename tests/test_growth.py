"""Work that must grow no faster than the input: forms of queries that hold no lists, pairs or windows as large as the tables, against the plain forms."""

from pyspark.sql import functions as F

from quern.operators import detection as operators
from quern.operators import matching, moderation
from quern.operators.intervals import version_counts, version_join
from quern.plans import detection, queries
from quern.streaming import limits


def test_grouped_answers_hold_no_lists(spark):
    """Each answer listed its candidates, so answers grew with signals times devices."""
    sf = "/root/testdata/sf0.001"
    given = detection._asked(spark, sf).where("event_id < 400"), detection.catalog(spark, sf), detection.screens(spark, sf)
    listed = {r["event_id"]: r.asDict(True) for r in operators.detect(*given, "event_id").collect()}
    answers, members = operators.detect_grouped(*given, "event_id")
    assert "candidates" not in answers.columns
    groups = {}
    for r in members.orderBy("id").collect():
        groups.setdefault(r["group"], []).append({"id": str(r["id"]), "label": r["name"]})
    got = answers.collect()
    assert len(got) == len(listed) and any(r["n_candidates"] > 1 for r in got)
    for r in got:
        want, own = listed[r["event_id"]], groups.get(r["group"], [])
        assert [m["id"] for m in own] == want["candidates"] and len(own) == r["n_candidates"]
        assert r["first_candidate"] == (own[0]["id"] if own else None)
        for c in ("platform", "type", "method", "status", "confidence", "exact", "device", "reasons", "unknown_codes", "unknown_screen"):
            assert r[c] == want[c], c
        asks = r["clarification"] and r["clarification"].asDict(True)
        if asks and asks["kind"] == "choose_candidate":
            asks["options"] = own + [{"id": "__other__", "label": "another model"}]
        assert asks == want["clarification"]


def test_next_times_keep_up_their_frame(spark):
    """A frame from each row to the end is read anew for each row, so a bucket cost the square of its times."""
    times = spark.createDataFrame([("a", t) for t in (1, 4, 9, 10, 11, 35, 36, 60)] + [("b", 3)], "key string, us long")
    found = limits._next_times(times, 10)
    assert {(r["key"], r["us"]): r["to"] for r in found.collect()} == {("a", 1): 11, ("a", 4): 35, ("a", 9): 35, ("a", 10): 35, ("a", 11): 35, ("a", 35): 60, ("a", 36): 60, ("a", 60): None, ("b", 3): None}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_version_counts_make_no_pairs_of_items(spark):
    """Each version met each item whose range it's in; items of equal bounds are one row now."""
    points = spark.createDataFrame([("3.1",), ("3.1",), ("7",), ("x",), (None,)], "v string")
    items = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.col("id") % 5, F.lit(".0"))).alias("lo"), F.when(F.col("id") % 4 > 0, F.concat(F.col("id") % 7 + 2, F.lit(".4"))).alias("hi"))
    want = version_join(points.distinct(), items, "v", "lo", "hi").groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum("id").alias("ids"))
    got = version_counts(points, items, "v", "lo", "hi", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [lo") < plan.rindex("Range")  # items are counted below the join


def test_matched_pairs_follow_forms(spark, tmp_path):
    """Each query met every device of its family; devices that differ in id, popularity and support alone are one form."""
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").where("p_partkey < 40")
    parts.write.parquet(f"{tmp_path}/one/part.parquet")
    copies = parts.crossJoin(spark.range(5).select((F.col("id") * 40).alias("more"))).withColumn("p_partkey", F.col("p_partkey") + F.col("more")).drop("more")
    copies.write.parquet(f"{tmp_path}/many/part.parquet")
    counts = [queries._matched(spark, f"{tmp_path}/{d}")[0].count() for d in ("one", "many")]
    assert counts[0] == counts[1] > 0


def test_screens_off_all_ratios_meet_few_cells(spark, monkeypatch):
    """An asked ratio that no screen has, and a place outside of all screens, made cells grow until they held most screens."""
    rounds, kept = [], moderation.checkpointed
    monkeypatch.setattr(moderation, "checkpointed", lambda df: rounds.append(1) or kept(df))
    screens = spark.range(40 * 40).select((F.col("id") % 40).cast("int").alias("w"), F.floor(F.col("id") / 40).cast("int").alias("h"), F.lit(1.0).alias("dpr"))
    asked = spark.createDataFrame([(1, 20, 20, 1.25), (2, 90, -70, 1.0)], "q int, w int, h int, dpr double")
    got = sorted((r["q"], r["rank"], r["w"], r["h"], r["distance"]) for r in moderation.nearest_screens(asked, screens, "q", 2).collect())
    assert got == [(1, 1, 20, 20, 25.0), (1, 2, 19, 20, 26.0), (2, 1, 39, 0, 121.0), (2, 2, 38, 0, 122.0)]
    assert len(rounds) <= 2 + 2 * 2  # two frames at first, and two a round


def test_top_trigrams_deal_pairs_by_their_number(spark, monkeypatch):
    """A join of few trigrams that makes many pairs was a task or a few, however many pairs there were."""
    tasks, kept = [], matching.top_k
    monkeypatch.setattr(matching, "top_k", lambda rows, *a: tasks.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]) or kept(rows, *a))
    monkeypatch.setattr(matching, "DEALT", 500, raising=False)
    own = spark.range(1000).select(F.concat(F.col("id").cast("string"), F.lit(" abc")).alias("o"))
    asks = spark.range(20).select(F.concat_ws(" ", F.lit("abc"), F.col("id") + 2000).alias("a"))
    got = matching.top_shared_trigrams(asks, own, "a", "o", 300).collect()
    assert len(got) == 20 * 300
    made = [(sum(t), max(t)) for t in tasks if t]
    assert max(made)[0] == 20 * 1000 and all(most < 0.2 * rows for rows, most in made if rows > 4000), made


def test_top_trigrams_of_an_ask_with_many_partners(spark, monkeypatch):
    """An ask of common trigrams alone meets all texts: its partners are several tasks, its rows those of all pairs."""
    monkeypatch.setattr(matching, "DEALT", 100, raising=False)
    monkeypatch.setattr(matching, "LISTED", 16, raising=False)
    own = spark.range(900).select(F.concat(F.lit("q "), F.col("id").cast("string")).alias("o"))
    asks = spark.createDataFrame([("q",), ("q q",), ("zz",), ("",), (None,)], "a string")
    got = matching.top_shared_trigrams(asks, own, "a", "o", 3).collect()
    first = sorted(f"q {i}" for i in range(900))[:3]
    by_ask = {a: [(r["o"], r["shared"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["a"] == a] for a in ("q", "q q", "zz", "")}
    assert by_ask["q"] == [(o, 2, i) for i, o in enumerate(first, 1)]
    assert [o for o, _, _ in by_ask["q q"]] == first and not by_ask["zz"] and not by_ask[""]
