"""Whole files: delimiters, lines that are no data, headers, realignment and the conditions it loses."""

from pyspark.sql import functions as F

from quern.sources import csv

ROW = "nokia,X{0},TA-1,android,phone,2020,{1},{2},none,,,,none,http://a,high,"


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file int, text string")


def test_tokens_by_a_column(spark):
    df = spark.createDataFrame([('a;"b;""c""";;"open;', ";"), ('"a""",b""c', ","), ("", ","), ('""', ",")], "l string, d string")
    assert [r[0] for r in df.select(csv.tokenise(F.col("l"), F.col("d"))).collect()] == [["a", 'b;"c"', "", "open;"], ['a"', "bc"], [""], [""]]


def test_lines_keep_their_numbers(spark):
    out = csv.preprocess(files(spark, "﻿```csv\r\na;b;c\rprose, with; one\n\n1;2;3\n```", None, "", "a,b,c;d"), 3).orderBy("file").collect()
    assert out[0]["notices"] == ["BOM_STRIPPED", "MARKDOWN_FENCE_STRIPPED", "DELIMITER_SEMICOLON", "PROSE_LINE_SKIPPED"]
    assert [(x["line_number"], x["line"]) for x in out[0]["lines"]] == [(2, "a;b;c"), (5, "1;2;3")]
    assert out[1]["lines"] == out[2]["lines"] == [] and out[3]["delimiter"] == "," and len(out[3]["lines"]) == 1


def test_devices(spark):
    header = ",".join(n for n, _, _ in csv.DEVICE_COLUMNS)
    lines = [header, ROW.format(1, "Да", ""), header, ROW.format(2, "conditional", "region:CN=no") + "a, b", ROW.format(3, "no", "").replace(",none,http", ",http"), "x,y,z"]
    out = csv.parse_devices(files(spark, "\n".join(lines))).orderBy("line_number").collect()
    assert [(r["line_number"], r["code"], r["realigned"]) for r in out] == [(2, None, False), (4, None, True), (5, None, True), (6, "FIELD_COUNT_MISMATCH", False)]
    assert (out[0]["esim_support"], out[0]["model_codes"], out[0]["esim_conditions"]) == ("yes", "TA-1", None)
    assert out[2]["dual_sim"] is None and out[2]["ru_market"] is None and out[2]["confidence"] == "high"
    assert (out[1]["notes"], out[1]["esim_conditions"]) == ("a,b", "region:CN=no")
    assert csv.format_notices(files(spark, "\n".join(lines)), csv.DEVICE_COLUMNS, csv.DEVICE_HEADER).first()["notices"] == ["REPEATED_HEADER_SKIPPED"]


def test_a_lost_condition_is_quarantined(spark):
    columns = [("brand", True, None), ("marketing_name", True, None), ("esim_support", True, ["yes", "conditional"]), ("esim_conditions", False, None), ("confidence", True, ["high"]), ("notes", False, None)]
    out = csv.parse(files(spark, "b,n,conditional,high,high\nb,n,yes,high,high"), columns, csv.DEVICE_HEADER, ["brand", "marketing_name", "esim_support"], ("esim_support", "conditional", "esim_conditions")).orderBy("line_number").collect()
    assert [(r["code"], r["realigned"], r["esim_conditions"], r["confidence"]) for r in out] == [("FIELD_COUNT_MISMATCH", True, None, "high"), (None, True, None, "high")]


def test_code_suffixes_and_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "16-a.csv").write_text("samsung,B,SM-1B,eu,supported,high,\nsamsung,N,,kr,same_as_global,low,n,m\nsamsung,Q,,mars,supported,high,,\n", "utf-8")
    (tmp_path / "src" / "01-b.csv").write_text("no data", "utf-8")
    read = csv.read_files(spark, str(tmp_path / "*"))
    assert sorted((r["source"], r["batch"], r["kind"]) for r in read.collect()) == [("src", "01-b", "devices"), ("src", "16-a", "code-suffixes")]
    out = csv.parse_code_suffixes(read.where("kind = 'code-suffixes'")).orderBy("line_number").collect()
    assert [(r["code"], r["code_suffix"], r["notes"]) for r in out] == [(None, "B", None), (None, "N", "n,m"), ("FIELD_COUNT_MISMATCH", None, None)]
    assert csv.parse_code_suffixes(read.where("false")).count() == 0
