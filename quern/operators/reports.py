"""What an import leaves behind: guards, comparison with a reference, tasks of what was rejected, the report; and the catalogue's pages."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.catalogue import first_examples, snapshot_diff
from quern.operators.moderation import page

LEVELS = ["verified", "derived", "unverified", "quarantined"]


def load_guard(devices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(devices that may be loaded, notices, quarantine): an iOS device needs a screen signature and a highest version.

    devices: id, platform, screens (array), max_version, source, batch, line and others.
    """
    missing = (F.col("platform") == "ios") & ((F.coalesce(F.size("screens"), F.lit(0)) <= 0) | F.col("max_version").isNull())
    bad = devices.where(missing)
    code = F.lit("IOS_FIELDS_MISSING").alias("code")
    return devices.where(~F.coalesce(missing, F.lit(False))), bad.select(code, "id"), bad.select(code, "source", "batch", "line", "id")


def reference_check(candidates: DataFrame, reference: DataFrame, id_: str, support: str) -> DataFrame:
    """candidates with expected and outcome: unknown (says nothing, passes), not-in-reference (passes), match or contradict."""
    own = reference.select(F.col(id_), F.col(support).alias("expected"))
    outcome = F.when(F.col(support) == "unknown", "unknown").when(F.col("expected").isNull(), "not-in-reference").when(F.col(support) == F.col("expected"), "match").otherwise("contradict")
    return candidates.join(own, id_, "left").withColumn("outcome", outcome)


def mismatch_rate(checked: DataFrame) -> DataFrame:
    """One row: checked, matched, and the share that contradicts (0 where nothing was checked)."""
    n = checked.agg(F.count_if(F.col("outcome").isin("match", "contradict")).alias("checked"), F.count_if(F.col("outcome") == "match").alias("matched"))
    return n.withColumn("rate", F.when(F.col("checked") == 0, 0.0).otherwise(1 - F.col("matched") / F.nullif("checked", F.lit(0))))


def rejection_tasks(quarantine: DataFrame, disagreements: DataFrame) -> DataFrame:
    """kind, key and payload (JSON) of each rejected row (code, source, batch, line, detail) and each disagreement (device, variants): what the task counter counts."""
    place = F.concat_ws(":", "code", "source", "batch", F.col("line").cast("string"))
    one = quarantine.select(F.lit("csv_quarantine").alias("kind"), place.alias("key"), F.to_json(F.struct("code", "source", "batch", "line", "detail")).alias("payload"))
    two = disagreements.select(F.lit("source_disagreement").alias("kind"), F.col("device").cast("string").alias("key"), F.to_json(F.struct("device", "variants")).alias("payload"))
    return one.unionByName(two)


def import_report(files: DataFrame, devices: DataFrame, quarantine: DataFrame, notices: DataFrame, checked: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The report's figures as rows: section, name, value (a number) and examples.

    files: parsed, realigned, empty (counts a file). devices: id, support, confidence. quarantine: code, source, batch, line, detail. notices:
    code, id. checked: as reference_check gives. previous: the devices of the last import.
    """
    none = F.array().cast("array<string>").alias("examples")
    row = lambda section, name, value: [F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("double").alias("value")]
    one = lambda df, section, *parts: df.select(F.explode(F.array(*[F.struct(*row(section, n, v)) for n, v in parts])).alias("r")).select("r.*", none)
    sums = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parsed", "realigned", "empty")])
    out = one(sums, "totals", ("lines parsed", F.col("parsed")), ("lines realigned", F.col("realigned")), ("without data", F.col("empty")))
    out = out.unionByName(one(devices.agg(F.count("*").alias("n")), "totals", ("accepted", F.col("n")))).unionByName(one(quarantine.agg(F.count("*").alias("n")), "totals", ("quarantined", F.col("n"))))
    place = F.concat(F.col("source"), F.lit("/"), F.col("batch"), F.lit(":"), F.lpad(F.col("line").cast("string"), 9, "0"), F.lit(" "), F.coalesce("detail", F.lit("")))
    out = out.unionByName(first_examples(quarantine.select("code", place.alias("p")), "code", "p", 3).select(*row("quarantine", F.col("code"), F.col("total")), "examples"))
    by_brand = notices.where("code = 'CODE_PATTERN_INVALID'").groupBy(F.split("id", "-")[0].alias("brand")).agg(F.count("*").alias("n"))
    out = out.unionByName(by_brand.select(*row("code patterns", F.col("brand"), F.col("n")), none))
    rate = mismatch_rate(checked)
    out = out.unionByName(one(rate, "reference", ("checked", F.col("checked")), ("matched", F.col("matched")), ("mismatch rate", F.col("rate"))))
    levels = devices.agg(*[F.count_if(F.col("confidence") == x).alias(x) for x in LEVELS])
    out = out.unionByName(one(levels, "confidence", *[(x, F.col(x)) for x in LEVELS]))
    if previous is not None:
        diff = snapshot_diff(previous, devices, "id", ["support", "confidence"]).agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "removed", "changed")])
        out = out.unionByName(one(diff, "since the last import", *[(x, F.col(x)) for x in ("added", "removed", "changed")]))
    return out


def write_report(report: DataFrame, path: str) -> None:
    """The report as a page of text (path/report.md, a folder of one part) and as JSON lines (path/report.json). Its rows are few: codes, brands and levels."""
    rows = report.orderBy("section", "name").collect()
    lines, section = ["# Import"], None
    for r in rows:
        if r["section"] != section:
            section = r["section"]
            lines += ["", f"## {section}", "", "| | |", "| --- | --- |"]
        shown = f"{r['value']:.4f}".rstrip("0").rstrip(".")
        lines.append(f"| {r['name']} | {shown}{''.join(f'<br>{x}' for x in r['examples'])} |")
    spark = report.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.md")
    spark.createDataFrame([(json.dumps({"section": r["section"], "name": r["name"], "value": r["value"], "examples": list(r["examples"])}, ensure_ascii=False),) for r in rows], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.json")


def browse(devices: DataFrame, number: int, size: int, brand: str | None = None, platform: str | None = None, columns: Sequence[str] = ("id", "brand_title", "display_name")) -> DataFrame:
    """A page of the active devices, by brand title and name as people order them, with the total of those that fit."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages are counted from 1 and have from 1 to 100 devices")
    rows = devices.where("status = 'active'")
    if brand is not None:
        rows = rows.where(F.lower("brand") == brand.strip().lower())
    if platform is not None:
        rows = rows.where(F.col("platform") == platform)
    order = [F.collate("brand_title", "UNICODE"), F.collate("display_name", "UNICODE"), F.asc("id")]
    return page(rows, order, number, size).select(*columns, "total")


def brands(devices: DataFrame) -> DataFrame:
    """brand, brand_title and devices of the brands that have an active device."""
    return devices.where("status = 'active'").groupBy("brand").agg(F.min("brand_title").alias("brand_title"), F.count("*").alias("devices"))
