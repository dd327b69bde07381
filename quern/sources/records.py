"""Checked scans of JSON records: a declared schema becomes expressions that part rows into good ones and rejects with reasons.

A record is read as a variant, so that a number isn't taken for a text, nor a text for a number. Reasons are `kind:field`:
missing, type, value (not an allowed one), range, length, format, unknown (a field that isn't declared, where the schema is closed),
and `json` or `object` for what is no record at all. Of good records of one key the last one wins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's types of the kinds of fields, and the kinds of variants they come from.
KINDS = {"string": "string", "int": "bigint", "number": "double", "boolean": "boolean", "strings": "array<string>", "object": "variant", "objects": "array<variant>"}
FORMS = {"string": "^STRING$", "int": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "strings": r"^ARRAY<(STRING|VOID)>$", "object": "^OBJECT", "objects": r"^ARRAY<(OBJECT.*|VOID)>$"}


@dataclass(frozen=True)
class Field:
    """A field of a record. low and high bound a number, shortest and longest a text's or list's length; form is a pattern of texts."""

    name: str
    kind: str = "string"
    required: bool = True
    nullable: bool = False
    allowed: Sequence = ()
    low: float | None = None
    high: float | None = None
    shortest: int | None = None
    longest: int | None = None
    form: str | None = None

    def path(self) -> str:
        return "$['" + self.name.replace("'", "\\'") + "']"

    def value(self, record: Column) -> Column:
        return F.try_variant_get(record, self.path(), KINDS[self.kind])

    def reason(self, record: Column) -> Column:
        """The first thing that is wrong with the field, null for nothing."""
        raw = F.try_variant_get(record, self.path(), "variant")
        form, value = F.schema_of_variant(raw), self.value(record)
        null = F.coalesce(F.is_variant_null(raw), F.lit(False))
        say = lambda what: F.lit(f"{what}:{self.name}")
        out = F.when(raw.isNull(), say("missing") if self.required else F.lit(None)).when(null, F.lit(None) if self.nullable else say("type")).when(~form.rlike(FORMS[self.kind]) | value.isNull(), say("type"))
        if self.allowed:
            out = out.when(~value.isin(*self.allowed), say("value"))
        if self.low is not None:
            out = out.when(value < self.low, say("range"))
        if self.high is not None:
            out = out.when(value > self.high, say("range"))
        size = F.length(value) if self.kind == "string" else F.size(value) if self.kind in ("strings", "objects") else None
        if size is not None and self.shortest is not None:
            out = out.when(size < self.shortest, say("length"))
        if size is not None and self.longest is not None:
            out = out.when(size > self.longest, say("length"))
        if self.form is not None:
            out = out.when(~value.rlike(self.form), say("format"))
        return out


def reasons(record: Column, fields: Sequence[Field], closed: bool = False) -> Column:
    """What is wrong with a record (a variant, null where there is no JSON), in the order of fields."""
    found = F.filter(F.array(*[f.reason(record) for f in fields]), lambda r: r.isNotNull())
    if closed:
        names = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
        unknown = F.transform(F.filter(F.array_sort(names), lambda n: ~n.isin(*[f.name for f in fields])), lambda n: F.concat(F.lit("unknown:"), n))
        found = F.concat(found, F.coalesce(unknown, F.array().cast("array<string>")))
    return F.when(record.isNull(), F.array(F.lit("json"))).when(~F.startswith(F.schema_of_variant(record), F.lit("OBJECT")), F.array(F.lit("object"))).otherwise(found)


def checked(rows: DataFrame, record: str, fields: Sequence[Field], keep: Sequence[str] = (), key: str | None = None, order: Sequence[str] = (), closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, rejects). good: the fields, typed, and the columns keep; rejects: keep, record and reasons.

    record: a column of JSON texts, or of variants. key: of good records that agree in this field the last by order stays.
    """
    given = F.col(record) if dict(rows.dtypes)[record] == "variant" else F.try_parse_json(record)
    judged = rows.select(*keep, *[c for c in order if c not in keep], F.col(record).alias("_given"), given.alias("_record")).withColumn("_reasons", reasons(F.col("_record"), fields, closed))
    good = judged.where(F.size("_reasons") == 0).select(*keep, *[c for c in order if c not in keep], *[f.value(F.col("_record")).alias(f.name) for f in fields])
    if key is not None:
        rest = [c for c in good.columns if c != key]
        last = good.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        good = last.select(*keep, *[key if f.name == key else F.col(f"_last.{f.name}").alias(f.name) for f in fields]) if not keep else last.select(*[F.col(f"_last.{c}").alias(c) for c in keep], *[key if f.name == key else F.col(f"_last.{f.name}").alias(f.name) for f in fields])
    else:
        good = good.select(*keep, *[f.name for f in fields])
    return good, judged.where(F.size("_reasons") > 0).select(*keep, F.col("_given").cast("string").alias("record"), F.col("_reasons").alias("reasons"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, place and record (variant) of the JSON files of a folder: a record a file, or a list of them.

    A file is one row here, as configuration files are; large record sets come as JSON lines (read_lines).
    """
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(path).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    several = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    items = F.when(several, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return files.select("file", F.posexplode(items).alias("place", "record"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (the text) of JSON lines, blank ones left out."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")


def read_checked(spark: SparkSession, path: str, fields: Sequence[Field], key: str, closed: bool = False) -> DataFrame:
    """The records of a folder's JSON files; the last of a key by file name and place stays. One bad record refuses all."""
    good, bad = checked(read_files(spark, path), "record", fields, (), key, ("file", "place"), closed)
    first = bad.limit(3).collect()
    if first:
        raise ValueError("records that don't fit: " + "; ".join(f"{', '.join(r['reasons'])} in {(r['record'] or '')[:80]}" for r in first))
    return good


def without_bad_overrides(devices: DataFrame, overrides: DataFrame, record: str, fields: Sequence[Field], device: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(devices, good overrides, rejects): a device whose override doesn't fit is left out, as its right state isn't known.

    target: the override's column that names the device, which is there whether its record fits or not.
    """
    good, bad = checked(overrides, record, fields, (target,))
    return devices.join(bad.select(F.col(target).alias(device)).distinct(), device, "left_anti"), good, bad


#: The parts of browser signals: texts, flags, whole numbers (rounded) and numbers of each.
SIGNALS = {
    "uaData": {"platform": "string", "mobile": "boolean", "model": "string", "platformVersion": "string", "architecture": "string", "bitness": "string"},
    "screen": {"width": "int", "height": "int", "availWidth": "int", "availHeight": "int", "dpr": "number", "orientation": "string"},
    "hardware": {"maxTouchPoints": "int", "hardwareConcurrency": "int", "deviceMemory": "number"},
    "webgl": {"vendor": "string", "renderer": "string"},
}


def _scalar(record: Column, path: str, kind: str) -> Column:
    """The value at path, null where it isn't of the kind or no finite number; whole numbers are rounded, halves up."""
    raw = F.try_variant_get(record, path, "variant")
    fits = F.schema_of_variant(raw).rlike(FORMS["number" if kind == "int" else kind])
    if kind in ("string", "boolean"):
        return F.when(fits, F.try_variant_get(record, path, kind))
    value = F.try_variant_get(record, path, "double")
    finite = F.when(fits & (F.abs(value) < float("inf")), value)
    return finite if kind == "number" else F.floor(finite + 0.5).cast("bigint")


def _pruned(parts: dict[str, Column]) -> Column:
    """A struct of parts, null where all of them are."""
    return F.when(F.coalesce(*[p.isNotNull() | F.lit(None) for p in parts.values()], F.lit(False)), F.struct(*[p.alias(n) for n, p in parts.items()]))


def signals(text: Column) -> Column:
    """Browser signals from a JSON text, as far as they can be read: struct(userAgent, uaData, screen, hardware, webgl).

    What is of the wrong kind or missing is null, as is a part of which nothing is left; a text that is no JSON is null altogether.
    uaData.brands are the names of the listed brands.
    """

    def read(record: Column) -> Column:
        parts = {}
        for part, fields in SIGNALS.items():
            inner = {n: _scalar(record, f"$.{part}.{n}", kind) for n, kind in fields.items()}
            if part == "uaData":
                brands = F.try_variant_get(record, "$.uaData.brands", "array<variant>")
                inner["brands"] = F.when(F.size(brands) >= 0, F.filter(F.transform(brands, lambda b: F.try_variant_get(b, "$.brand", "string")), lambda b: b.isNotNull()))
            parts[part] = _pruned(inner)
        return F.when(record.isNotNull(), F.struct(_scalar(record, "$.userAgent", "string").alias("userAgent"), *[p.alias(n) for n, p in parts.items()]))

    return F.get(F.transform(F.array(F.try_parse_json(text)), read), F.lit(0))
