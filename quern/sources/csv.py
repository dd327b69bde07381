"""Dirty delimited files: lines with their numbers, delimiters, a quote-aware tokeniser, realignment, and the parsers of both files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text


# The columns of the two files, whether they are required, and their closed sets of values.
DEVICE_COLUMNS = [
    ("brand", True, None),
    ("marketing_name", True, None),
    ("model_codes", False, None),
    ("platform", True, ["ios", "android", "harmonyos", "other"]),
    ("device_type", True, ["phone", "tablet", "watch", "laptop", "other"]),
    ("release_year", True, None),
    ("esim_support", True, ["yes", "no", "conditional", "unknown"]),
    ("esim_conditions", False, None),
    ("dual_sim", False, ["physical+esim", "dual-esim", "esim-only", "none", "unknown"]),
    ("max_esim_profiles", False, None),
    ("os_min_version", False, None),
    ("os_max_version", False, None),
    ("ru_market", False, ["official", "parallel", "none", "unknown"]),
    ("source_url", False, None),
    ("confidence", True, ["high", "medium", "low"]),
    ("notes", False, None),
]
DEVICE_IDENTITY = ["brand", "marketing_name", "model_codes", "platform", "device_type", "release_year", "esim_support"]
DEVICE_HEADER = ["brand", "marketing_name", "esim_support"]
SUFFIX_COLUMNS = [
    ("brand", True, None),
    ("code_suffix", True, None),
    ("code_example", False, None),
    ("region", True, ["eu", "ru", "ca", "cn", "us", "kr", "in", "jp", "tr", "latam", "mea", "sea", "global", "unknown"]),
    ("esim_effect", True, ["supported", "not_supported", "same_as_global", "unknown"]),
    ("confidence", True, ["high", "medium", "low"]),
    ("notes", False, None),
]
SUFFIX_HEADER = ["brand", "code_suffix", "region"]
YES_NO = {"да": "yes", "нет": "no", "true": "yes", "false": "no", "1": "yes", "0": "no"}
FENCE = r"^\s*```"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """source, batch, kind and text of the files <source>/<batch>.csv under path, each of which is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    named = whole.select(F.regexp_extract("file", "([^/]+)/[^/]+[.]csv$", 1).alias("source"), F.regexp_extract("file", "([^/]+)[.]csv$", 1).alias("batch"), "text")
    return named.withColumn("kind", F.when(F.startswith("batch", F.lit("16-")), "code-suffixes").otherwise("devices"))


def unquoted(line: Column, char: str) -> Column:
    """How often a character stands outside quotes."""
    bare = F.regexp_replace(line, '"[^"]*("|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(char), F.lit("")))


def delimiter(line: Column, width: int) -> Column:
    """The semicolon where it gives a number of fields nearer to width than the comma does."""
    off = lambda char: F.abs(unquoted(line, char) + 1 - width)
    return F.when(off(";") < off(","), ";").otherwise(",")


def tokenise(line: Column, by: str | Column = ",") -> Column:
    """Fields of a line: quotes toggle anywhere, a doubled quote within quotes is one, fields are trimmed."""
    by = F.lit(by) if isinstance(by, str) else by
    # Pieces between quotes stand by turns outside and inside of them; an empty outer piece in the middle is a doubled quote.
    pieces = F.split(line, '"', -1)
    last = F.size(pieces) - 1
    marked = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), F.lit('"')).otherwise(F.replace(p, by, F.lit("\x01"))))
    return F.transform(F.split(F.array_join(marked, ""), "\x01", -1), lambda f: F.trim(f))


def preprocess(files: DataFrame, width: int) -> DataFrame:
    """files with delimiter, lines (line_number, line) and notices instead of text.

    A byte order mark, fences, blank lines and lines of fewer than two delimiters go. Line numbers are those of the file. A null or
    empty text has no lines.
    """
    bom = F.startswith(F.coalesce("text", F.lit("")), F.lit("\ufeff"))
    every = F.transform(F.split(F.regexp_replace("text", "^\ufeff", ""), "\r\n|\r|\n", -1), lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")))
    out = files.withColumn("_bom", bom).withColumn("_all", F.coalesce(every, F.array().cast("array<struct<line_number:int,line:string>>")))
    out = out.withColumn("_bare", F.filter("_all", lambda x: ~x["line"].rlike(FENCE))).withColumn("_said", F.filter("_bare", lambda x: x["line"].rlike(r"\S")))
    out = out.withColumn("delimiter", delimiter(F.coalesce(F.get("_said", F.lit(0))["line"], F.lit("")), width))
    enough = lambda x: F.when(F.col("delimiter") == ";", unquoted(x["line"], ";")).otherwise(unquoted(x["line"], ",")) >= 2
    out = out.withColumn("lines", F.filter("_said", enough))
    noted = [
        F.when(F.col("_bom"), "BOM_STRIPPED"),
        F.when(F.size("_bare") < F.size("_all"), "MARKDOWN_FENCE_STRIPPED"),
        F.when(F.col("delimiter") == ";", "DELIMITER_SEMICOLON"),
        F.when(F.size("lines") < F.size("_said"), "PROSE_LINE_SKIPPED"),
    ]
    return out.withColumn("notices", F.array_compact(F.array(*noted))).drop("text", "_bom", "_all", "_bare", "_said")


def _is_header(fields: Column, names: Sequence[str]) -> Column:
    lower = F.transform(fields, F.lower)
    return F.array_size(F.array_intersect(lower, F.array(*[F.lit(n) for n in names]))) == len(names)


def format_notices(files: DataFrame, columns: Sequence[tuple], header: Sequence[str]) -> DataFrame:
    """files with the notices of their form, those of a missing and of repeated headers among them."""
    out = preprocess(files, len(columns))
    heads = F.transform("lines", lambda x: _is_header(tokenise(x["line"], F.col("delimiter")), header))
    first = F.coalesce(F.get(heads, F.lit(0)), F.lit(False))
    again = F.size(F.filter(heads, lambda h: h)) > F.when(first, 1).otherwise(0)
    late = F.array_compact(F.array(F.when((F.size("lines") > 0) & ~first, "HEADER_MISSING"), F.when(again, "REPEATED_HEADER_SKIPPED")))
    return out.withColumn("notices", F.concat("notices", late)).drop("lines", "delimiter")


def parse(files: DataFrame, columns: Sequence[tuple], header: Sequence[str], identity: Sequence[str], conditional: tuple[str, str, str] | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """A row per data line of files (text and any keys): the keys, line_number, line, code, realigned and the columns, empty ones null.

    columns: (name, required, closed set of values or None). A line with the header's names is no data. code is FIELD_COUNT_MISMATCH where no or no
    single realignment of the line is left, or, by conditional (status column, value, condition column), where a row of that status
    lost its condition to realignment. aliases: other words for the values of the status column.
    """
    names = [n for n, _, _ in columns]
    keys = [c for c in files.columns if c != "text"]
    lines = preprocess(files, len(columns)).select(*keys, "delimiter", F.explode("lines").alias("_l"))
    lines = lines.select(*keys, "_l.line_number", "_l.line", tokenise(F.col("_l.line"), F.col("delimiter")).alias("_f")).where(~_is_header(F.col("_f"), header))
    closed = [(i, need, values) for i, (_, need, values) in enumerate(columns) if values]

    def valid(r: Column) -> Column:
        ok = F.lit(True)
        for i, need, values in closed:
            ok = ok & F.lower(F.get(r, F.lit(i))).isin(*values, *([] if need else [""]))
        return ok

    out = lines.withColumn("_r", realign("_f", len(columns), valid, [names.index(n) for n in identity]))
    field = lambda n: F.get("_r.fields", F.lit(names.index(n)))
    status = conditional[0] if conditional else None

    def said(n: str) -> Column:
        if n != status or not aliases:
            return F.nullif(field(n), F.lit(""))
        low = F.lower(field(n))
        return F.nullif(F.coalesce(text.literal_map(dict(aliases))[low], low), F.lit(""))

    recovered = F.col("_r.outcome") == "recovered"
    lost = (recovered & field(conditional[2]).isNull() & (said(status) == conditional[1])) if conditional else F.lit(False)
    code = F.when(~F.col("_r.outcome").isin("exact", "recovered") | F.coalesce(lost, F.lit(False)), "FIELD_COUNT_MISMATCH")
    return out.select(*keys, "line_number", "line", code.alias("code"), recovered.alias("realigned"), *[said(n).alias(n) for n in names])


def parse_devices(files: DataFrame) -> DataFrame:
    return parse(files, DEVICE_COLUMNS, DEVICE_HEADER, DEVICE_IDENTITY, ("esim_support", "conditional", "esim_conditions"), YES_NO)


def parse_code_suffixes(files: DataFrame) -> DataFrame:
    return parse(files, SUFFIX_COLUMNS, SUFFIX_HEADER, [n for n, _, _ in SUFFIX_COLUMNS[:6]])


def subsets(n: Column, k: Column, most: int) -> Column:
    """The first `most` sets of k of the places 0..n-1, in lexicographic order; none where k > n."""

    def longer(sets: Column, i: Column) -> Column:
        # Up to the last place that leaves room for the rest: each set here has a completion, so cutting the list is safe.
        grown = lambda c: F.transform(F.sequence(F.coalesce(F.get(c, i - 1) + 1, F.lit(0)), n - k + i), lambda j: F.concat(c, F.array(j)))
        return F.slice(F.flatten(F.transform(sets, grown)), 1, most)

    none = F.array().cast("array<array<int>>")
    return F.when(k > n, none).otherwise(F.aggregate(F.sequence(F.lit(0), k - 1), F.array(F.array().cast("array<int>")), longer))


def realign(fields: Column | str, width: int, valid, identity: Sequence[int], most: int = 4000) -> Column:
    """A row of `width` fields from one with too many or too few: struct(outcome, fields, cut).

    valid: a column expression for a candidate row. Too many: the tail is merged, or empty fields go. Too few:
    empty fields are put in at each set of places. Valid candidates must agree on the identity fields; others
    that differ become null. Any number of fields too many or too few is tried; of the sets of places, the first
    `most` in lexicographic order. cut tells the rows that have more sets, whose outcome another bound could change.
    """
    fields = F.col(fields) if isinstance(fields, str) else fields
    n = F.size(fields)

    def short() -> Column:
        filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(F.array_contains(c, i), F.lit("")).otherwise(F.get(fields, i - F.size(F.filter(c, lambda x: x < i)))))
        return F.transform(subsets(F.lit(width), F.lit(width) - n, most), filled)

    def long() -> Column:
        merged = F.concat(F.slice(fields, 1, width - 1), F.array(F.array_join(F.slice(fields, F.lit(width), n), ",")))
        empty = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(fields, i) == "")
        cut = lambda c: F.filter(fields, lambda _, i: ~F.exists(c, lambda x: F.get(empty, x) == i))
        return F.concat(F.array(merged), F.transform(subsets(F.size(empty), n - width, most), cut))

    def settled(options: Column) -> Column:
        first = F.get(options, F.lit(0))
        same = F.lit(True)
        for i in identity:
            same = same & F.forall(options, lambda r: F.get(r, F.lit(i)) == F.get(first, F.lit(i)))
        agreed = F.array(*[F.when(F.forall(options, lambda r: F.get(r, F.lit(i)) == F.get(first, F.lit(i))), F.get(first, F.lit(i))) for i in range(width)])
        outcome = F.when(n == width, "exact").when(options.isNull() | (F.size(options) == 0), "unresolvable").when(~same, "identity-ambiguous").otherwise("recovered")
        return F.struct(outcome.alias("outcome"), F.when(n == width, fields).when(outcome == "recovered", agreed).alias("fields"), cut_off.alias("cut"))

    def sets(n: Column, k: Column) -> Column:
        """How many sets of k of n places there are."""
        steps = F.when((k > 0) & (k <= n), F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
        return F.when(k > n, 0.0).otherwise(F.aggregate(steps, F.lit(1.0), lambda c, i: c * (n - k + i) / i))

    empties = F.size(F.filter(fields, lambda x: x == ""))
    cut_off = F.coalesce(F.when(n < width, sets(F.lit(width), F.lit(width) - n)).when(n > width, sets(empties, n - width)) > most + 0.5, F.lit(False))
    options = F.array_distinct(F.filter(F.when(n < width, short()).when(n > width, long()), valid))
    return F.get(F.transform(F.array(options), settled), F.lit(0))  # options are made once
