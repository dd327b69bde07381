"""Statistics of whole texts as built-in column expressions: no Python runs on the executors.

Words are runs of anything but ASCII white space. Null texts count as empty: all statistics 0.

Repeated words: hashes of the 8-word windows are compared as 64-bit values. Only texts with a repeated window
have their windows sorted; the words that the repeated windows cover are counted from the gaps between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import WORD

WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_distinct_words", "n_lines", "n_upper", "n_digits", "n_bangs", "n_chars"]
#: What the learners see: shares and means, which don't depend on a text's length alone.
FEATURES = ["n_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "bang_share", "line_words"]


def _without(chars: str):
    return F.length("_st_text") - F.length(F.translate("_st_text", chars, ""))


def with_statistics(docs: DataFrame, more: bool = True) -> DataFrame:
    """The columns of docs with the counts (names starting with _st_)."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    w = WINDOW
    a = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_st_text"))
    a = a.select("*", F.regexp_extract_all("_st_text", F.lit(WORD), F.lit(0)).alias("_st_words"), F.filter(F.split("_st_text", "\n", -1), lambda x: x.rlike(WORD)).alias("_st_lines"))
    hashes = F.transform("_st_words", lambda x: F.xxhash64(x))
    a = a.select("*", F.size("_st_words").cast("long").alias("_st_n_words"), hashes.alias("_st_hash"))
    windows = F.when(F.col("_st_n_words") >= w, F.transform(F.sequence(F.lit(1), F.size("_st_hash") - (w - 1)), lambda i: F.xxhash64(F.slice("_st_hash", i, w)))).otherwise(F.array().cast("array<bigint>"))
    counts = [
        (F.length("_st_text") - F.length(F.regexp_replace("_st_text", WORD, ""))).cast("long").alias("_st_word_chars"),
        _without("#*$%&|<>").cast("long").alias("_st_n_symbols"),
        (F.size("_st_lines") - F.size(F.array_distinct("_st_lines"))).cast("long").alias("_st_n_dup_lines"),
    ]
    if more:
        counts += [
            F.size(F.array_distinct("_st_hash")).cast("long").alias("_st_n_distinct_words"),
            F.size("_st_lines").cast("long").alias("_st_n_lines"),
            F.length(F.regexp_replace("_st_text", "[^A-Z]+", "")).cast("long").alias("_st_n_upper"),
            F.length(F.regexp_replace("_st_text", "[^0-9]+", "")).cast("long").alias("_st_n_digits"),
            _without("!").cast("long").alias("_st_n_bangs"),
            F.length("_st_text").cast("long").alias("_st_n_chars"),
        ]
    a = a.select(*keep, "_st_n_words", *counts, windows.alias("_st_windows"))
    rest = [c for c in a.columns if c != "_st_windows"]
    rest = [F.col(f"`{c}`") for c in rest]
    repeats = F.size(F.array_distinct("_st_windows")) < F.size("_st_windows")
    a = a.select(*rest, F.when(repeats, F.sort_array(F.transform("_st_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_st_sorted"))
    places = F.sort_array(F.filter(F.transform("_st_sorted", lambda x, i: F.when(F.coalesce(F.get("_st_sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_st_sorted", i + 1)["h"] == x["h"], F.lit(False)), x["i"])), lambda x: x.isNotNull()))
    a = a.select(*rest, F.when(F.col("_st_sorted").isNotNull(), places).alias("_st_places"))
    gaps = F.transform("_st_places", lambda x, i: F.when(i == 0, F.lit(w)).otherwise(F.least(F.lit(w), x - F.get("_st_places", i - 1))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return a.select(*rest, F.coalesce(F.when(F.col("_st_places").isNotNull(), covered), F.lit(0)).cast("long").alias("_st_n_repeat_words"))


def feature_columns() -> dict:
    """The learners' features, over the counts of with_statistics; 0 where there is nothing to divide by."""
    c = lambda n: F.col(f"_st_{n}").cast("double")
    per = lambda a, b: F.coalesce(F.when(c(b) > 0, c(a) / c(b)), F.lit(0.0))
    found = [c("n_words"), per("word_chars", "n_words"), per("n_symbols", "n_chars"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_distinct_words", "n_words"), per("n_upper", "n_chars"), per("n_digits", "n_chars"), per("n_bangs", "n_chars"), per("n_words", "n_lines")]
    return dict(zip(FEATURES, found))


def labelled_features(counted: DataFrame, sample: DataFrame) -> list:
    """label and x (FEATURES in order) of the counted rows in sample (doc_id, label): one row per id, the least, in the order of ids."""
    named = F.struct(*[c.alias(n) for n, c in feature_columns().items()])
    found = counted.select("doc_id", named.alias("x")).join(sample, "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    return found.orderBy("doc_id").collect()  # as many rows as sample has, at most
