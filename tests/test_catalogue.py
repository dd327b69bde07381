import random
from itertools import combinations, islice

import pytest
from pyspark.sql import functions as F

from quern.functions import rules
from quern.operators import catalogue as cat
from quern.sources import csv
from quern.streaming import tasks


def test_majority_ties_are_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", None)], "g string, v int")
    assert {r["g"]: r["v"] for r in cat.majority(df, "g", "v").collect()} == {"a": 1, "b": None, "c": None}


def test_consensus_outcomes(spark):
    rows = [("a", "supported"), ("a", "supported"), ("b", "supported"), ("b", "not_supported"), ("c", "supported"), ("c", "conditional"), ("d", "unknown"), ("e", "not_supported")]
    got = {r["id"]: (r["outcome"], r["status"]) for r in cat.consensus(spark.createDataFrame(rows, "id string, s string"), "id", "s").collect()}
    assert got == {"a": ("unanimous", "supported"), "b": ("quarantined", None), "c": ("caution-rule", "conditional"), "d": ("no-data", None), "e": ("single-source", "not_supported")}


def test_override_sets_null(spark):
    base = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "k int, a string, b int")
    patch = spark.createDataFrame([(1, ["a"], None, 9)], "k int, set array<string>, a string, b int")
    assert {tuple(r) for r in cat.merge_override(base, patch, "k", ["a", "b"]).collect()} == {(1, None, 2), (2, "y", 3)}


def test_gate():
    cat.gate(80, 20)
    with pytest.raises(ValueError):
        cat.gate(79, 21)


def test_conditions_and_versions(spark):
    row = spark.range(1)
    conditions = F.array(F.struct(F.lit("region").alias("scope"), F.lit("CN").alias("value"), F.lit("not_supported").alias("support")))
    status = lambda region: row.select(rules.resolve_conditions(F.lit("conditional"), conditions, F.lit(region).cast("string"), F.lit(None).cast("string"))).first()[0]
    assert (status(" cn"), status("eu"), status(None)) == ("not_supported", "supported", "clarification_required")
    assert row.select(rules.in_version_range(F.lit("17.10"), F.lit("17.9"), F.lit(None).cast("string"))).first()[0]


def test_tokenise_and_realign(spark):
    line = 'a , "b, ""c""" ,d,'
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(csv.tokenise(F.col("l"))).first()[0] == ["a", 'b, "c"', "d", ""]
    df = spark.createDataFrame([(["A", "1", "x", "y"],), (["A", "x"],), (["A", "1", "x"],)], "f array<string>")
    out = df.select(csv.realign(F.col("f"), 3, lambda r: F.get(r, F.lit(1)).rlike("^[0-9]?$"), [0]).alias("r")).collect()
    assert [r["r"]["outcome"] for r in out] == ["recovered", "recovered", "exact"]
    assert out[0]["r"]["fields"] == ["A", "1", "x,y"]


def test_realign_any_difference(spark):
    rng = random.Random(3)

    def plain(row, width, most):
        d = len(row) - width
        if d > 0:
            empty = [i for i, x in enumerate(row) if x == ""]
            made = [row[: width - 1] + [",".join(row[width - 1 :])]] + [[x for i, x in enumerate(row) if i not in c] for c in islice(combinations(empty, d), most)]
        else:
            made = []
            for c in islice(combinations(range(width), -d), most):
                rest = iter(row)
                made.append(["" if i in c else next(rest) for i in range(width)])
        good = [r for r in made if r[0] == "A" and r[2] in ("", "1")]
        if not good:
            return "unresolvable", None
        if len({r[0] for r in good}) > 1:
            return "identity-ambiguous", None
        return "recovered", [x[0] if len(set(x)) == 1 else None for x in zip(*good)]

    rows = [["A", "b", "1", "c", "x", "y", "z", "w"], ["A", "b"], ["A", "", "", "", "", "b", "1", "c", "d"], ["A"] + [""] * 14 + ["1"], []]
    rows += [["A"] + [rng.choice(["", "1", "b"]) for _ in range(rng.choice([0, 1, 2, 5, 7, 9, 12]))] for _ in range(40)]
    rows = [r for r in rows if len(r) != 5]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, f array<string>")
    valid = lambda r: (F.get(r, F.lit(0)) == "A") & F.get(r, F.lit(2)).isin("", "1")
    for most in (4000, 7):
        got = {x["i"]: (x["r"]["outcome"], x["r"]["fields"]) for x in df.select("i", csv.realign(F.col("f"), 5, valid, [0], most).alias("r")).collect()}
        assert got == {i: plain(r, 5, most) for i, r in enumerate(rows)}
    line = ["m", *["f"] * 14, "note", "with", "three", "commas"]  # 16 columns
    out = spark.createDataFrame([(line,)], "f array<string>").select(csv.realign(F.col("f"), 16, lambda r: F.get(r, F.lit(0)) == "m", [0]).alias("r")).first()["r"]
    assert (out["outcome"], out["fields"][15], out["cut"]) == ("recovered", "note,with,three,commas", False)
    rows = [(["x"] * 9, False), (["x"] * 8, True), (["x"] * 16, False), (["x"] * 14 + [""] * 8, False), (["x"] * 4 + [""] * 18, True)]  # C(16, 7), C(16, 8), none, C(8, 6), C(18, 6)
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, f array<string>")
    got = df.select("i", csv.realign(F.col("f"), 16, lambda r: F.lit(False), [0], 11_440).alias("r")).orderBy("i").collect()
    assert [x["r"]["cut"] for x in got] == [c for _, c in rows]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"u{i % 5}", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, u string, p int")
    for k in range(3):
        df.where(F.col("t") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    final = {}
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = tasks.stream_tasks(source, ["u"], "t", "p", lambda b, n: final.update({r["u"]: tuple(r) for r in b.collect()}), str(tmp_path / "cp"))
    q.awaitTermination()
    assert set(final.values()) == {tuple(r) for r in tasks.count_tasks(df, ["u"], "t", "p").collect()}


def test_rounds_of_self_joins_keep_estimates_small(spark):
    rows = spark.range(4).select("id", F.col("id").alias("to"))
    for _ in range(8):
        rows = cat.checkpointed(rows.join(rows.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")))
    assert rows.count() == 4
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000
