"""Guards, reference, tasks, report files, pages and overrides of parts by worked cases."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import catalogue as cat
from quern.operators import moderation, reports


def test_load_guard(spark):
    rows = [("a", "ios", ["x"], "17"), ("b", "ios", [], "17"), ("c", "ios", None, "17"), ("d", "ios", ["x"], None), ("e", "android", None, None), ("f", None, None, None)]
    df = spark.createDataFrame([(*r, "s", "b1", 3) for r in rows], "id string, platform string, screens array<string>, max_version string, source string, batch string, line int")
    good, notices, bad = reports.load_guard(df)
    assert sorted(r["id"] for r in good.collect()) == ["a", "e", "f"]
    assert sorted(tuple(r) for r in notices.collect()) == [("IOS_FIELDS_MISSING", x) for x in "bcd"]
    assert sorted((r["id"], r["line"]) for r in bad.collect()) == [("b", 3), ("c", 3), ("d", 3)]


def test_reference(spark):
    c = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "unknown"), (4, "yes")], "id int, s string")
    r = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, "no")], "id int, s string")
    got = reports.reference_check(c, r, "id", "s")
    assert {x["id"]: x["outcome"] for x in got.collect()} == {1: "match", 2: "contradict", 3: "unknown", 4: "not-in-reference"}
    assert tuple(reports.mismatch_rate(got).first()) == (2, 1, 0.5)
    assert tuple(reports.mismatch_rate(got.where("id > 2")).first()) == (0, 0, 0.0)


def test_report_files(spark, tmp_path):
    files = spark.createDataFrame([(10, 2, 1), (5, None, 0)], "parsed int, realigned int, empty int")
    devices = spark.createDataFrame([("a", "yes", "verified"), ("b", "no", "derived")], "id string, support string, confidence string")
    quarantine = spark.createDataFrame([("X", "s", "b", n, None) for n in (30, 4, 200, 1)], "code string, source string, batch string, line int, detail string")
    notices = spark.createDataFrame([("CODE_PATTERN_INVALID", "acme-one"), ("CODE_PATTERN_INVALID", "acme-two"), ("OTHER", "acme-x")], "code string, id string")
    checked = reports.reference_check(devices, devices, "id", "support")
    old = spark.createDataFrame([("a", "no", "verified"), ("z", "no", "derived")], "id string, support string, confidence string")
    report = reports.import_report(files, devices, quarantine, notices, checked, old)
    got = {(r["section"], r["name"]): r["value"] for r in report.collect()}
    assert got["totals", "lines parsed"] == 15 and got["totals", "lines realigned"] == 2 and got["totals", "accepted"] == 2 and got["totals", "quarantined"] == 4
    assert got["code patterns", "acme"] == 2 and got["reference", "mismatch rate"] == 0 and got["confidence", "unverified"] == 0
    assert [got["since the last import", x] for x in ("added", "removed", "changed")] == [1, 1, 1]
    examples = [r["examples"] for r in report.collect() if r["section"] == "quarantine"][0]
    assert [x.split(":")[1].lstrip("0").strip() for x in examples] == ["1", "4", "30"]
    reports.write_report(report, str(tmp_path / "out"))
    page = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out" / "report.md")).collect())
    assert "## totals" in page and "| lines parsed | 15 |" in page
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out" / "report.json")).collect()]
    assert {(x["section"], x["name"]): x["value"] for x in lines} == got
    nothing = reports.import_report(files.where("false"), devices.where("false"), quarantine.where("false"), notices.where("false"), checked.where("false"))
    assert {r["value"] for r in nothing.collect()} == {0.0}


def test_pages_are_in_the_order_of_people(spark):
    rows = [("1", "b", "Bravo", "Zeta", "ios", "active"), ("2", "a", "alpha", "beta", "ios", "active"), ("3", "a", "Alpha", "Älteste", "ios", "active"), ("4", "a", "alpha", "Alt", "android", "active"), ("5", "a", "alpha", "aaa", "ios", "deprecated")]
    df = spark.createDataFrame(rows, "id string, brand string, brand_title string, display_name string, platform string, status string")
    assert [(r["id"], r["total"]) for r in reports.browse(df, 1, 3).collect()] == [("4", 4), ("2", 4), ("3", 4)]
    assert [r["id"] for r in reports.browse(df, 2, 3).collect()] == ["1"]
    assert [r["id"] for r in reports.browse(df, 1, 10, " A ", "ios").collect()] == ["2", "3"]
    assert reports.browse(df, 9, 10).collect() == []
    for number, size in ((0, 5), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            reports.browse(df, number, size)
    assert {(r["brand"], r["devices"]) for r in reports.brands(df).collect()} == {("a", 3), ("b", 1)}


def test_override_of_parts_and_patches(spark):
    part = "struct<support:string,question:string>"
    base = spark.createDataFrame([(i, ("yes", "old"), "x") for i in range(5)], f"id int, esim {part}, level string")
    patch = spark.createDataFrame([(0, ["esim.support"], ("no", "new"), None), (1, ["esim.question"], (None, None), None), (2, ["esim.support"], (None, None), None), (3, ["level"], None, None)], f"id int, set array<string>, esim {part}, level string")
    got = {r["id"]: (r["esim"]["support"], r["esim"]["question"], r["level"]) for r in cat.merge_override(base, patch, "id", ["level"], {"esim": ["support", "question"]}, ["esim.question"]).collect()}
    assert got == {0: ("no", "old", "x"), 1: ("yes", None, "x"), 2: ("yes", "old", "x"), 3: ("yes", "old", None), 4: ("yes", "old", "x")}
    c = F.col
    df = spark.createDataFrame([(("a", "b"), ("c", None), ["y"]), (("a", "b"), ("c", None), None)], "o struct<x:string,y:string>, n struct<x:string,y:string>, s array<string>")
    assert [tuple(r["m"]) for r in df.select(moderation.merged_patch(c("o"), c("n"), c("s"), ["x", "y"]).alias("m")).collect()] == [("a", None), ("a", "b")]
    df = spark.createDataFrame([(["u"], "derived", None), (["u"], "derived", "u"), ([], "verified", None), (None, "verified", None), (None, "derived", None)], "s array<string>, c string, u string")
    sources, sure = moderation.with_source(c("s"), c("c"), c("u"))
    got = [tuple(r) for r in df.select(sources.alias("s"), sure.alias("c")).select("s", "c", moderation.patch_fault(c("s"), c("c"))).collect()]
    assert got == [(["u"], "derived", None), (["u"], "verified", None), ([], "verified", "VALIDATION_ERROR"), (None, "verified", "VALIDATION_ERROR"), (None, "derived", None)]


def test_tasks_of_rejected_rows(spark):
    q = spark.createDataFrame([("X", "s", "b", 3, "why")], "code string, source string, batch string, line int, detail string")
    d = spark.createDataFrame([("d1", ["no", "yes"])], "device string, variants array<string>")
    got = {r["kind"]: (r["key"], json.loads(r["payload"])) for r in reports.rejection_tasks(q, d).collect()}
    assert got == {"csv_quarantine": ("X:s:b:3", {"code": "X", "source": "s", "batch": "b", "line": 3, "detail": "why"}), "source_disagreement": ("d1", {"device": "d1", "variants": ["no", "yes"]})}
