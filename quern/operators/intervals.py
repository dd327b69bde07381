"""Joins of versions with ranges of versions, as equi-joins on blocks of major numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.rules import in_version_range

#: Major numbers from 0 to 2**LEVELS - 1; larger ones fall together with the last, which the exact check tells apart.
LEVELS = 10


def _major(version: Column, open_: int) -> Column:
    """The version's first number within the numbers that blocks have; open_ for null, and 0 for no number."""
    n = F.regexp_extract(version, r"^\s*\+?(\d+)", 1).try_cast("bigint")
    # A number past a long is a large one.
    n = F.when(version.rlike(r"^\s*\+?\d{19}"), F.lit(2**LEVELS - 1)).otherwise(F.coalesce(n, F.lit(0)))
    return F.when(version.isNull(), F.lit(open_)).otherwise(F.least(n, F.lit(2**LEVELS - 1))).cast("int")


def point_blocks(major: Column) -> Column:
    """Every block of 1, 2, 4, ... numbers that holds major: array of (level, block)."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(major, k).alias("block")) for k in range(LEVELS + 1)])


def range_blocks(low: Column, high: Column) -> Column:
    """The fewest blocks that cover low to high, two at most of a size. Each number of the range is in just one of them."""
    start = F.struct(low.alias("lo"), (high + 1).alias("hi"), F.array().cast("array<struct<level:int,block:int>>").alias("found"))
    block = lambda k, b: F.struct(k.alias("level"), b.alias("block"))

    def step(s: Column, k: Column) -> Column:
        more = s["lo"] < s["hi"]
        left, right = more & (s["lo"] % 2 == 1), more & (s["hi"] % 2 == 1) & ((s["hi"] - 1 > s["lo"]) | (s["lo"] % 2 == 0))
        none = F.array().cast("array<struct<level:int,block:int>>")
        found = F.concat(s["found"], F.when(left, F.array(block(k, s["lo"]))).otherwise(none), F.when(right, F.array(block(k, s["hi"] - 1))).otherwise(none))
        return F.struct(F.shiftright(s["lo"] + left.cast("int"), 1).alias("lo"), F.shiftright(s["hi"] - right.cast("int"), 1).alias("hi"), found.alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["found"])


def version_join(points: DataFrame, ranges: DataFrame, version: str, low: str, high: str, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of points and ranges with low <= version <= high (a null bound is open; a null version is in no range), equal in the columns on.

    A range is cut into blocks of major numbers and a version asks for the blocks it is in, one of which the range has if its major
    fits: an equi-join, that Spark can shuffle or broadcast, and then the exact check. No pair comes twice.
    """
    last = 2**LEVELS - 1
    p = points.where(F.col(version).isNotNull()).withColumn("_b", F.explode(point_blocks(_major(F.col(version), 0)))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    r = ranges.withColumn("_b", F.explode(range_blocks(_major(F.col(low), 0), _major(F.col(high), last)))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    return p.join(r, [*on, "_level", "_block"]).where(in_version_range(F.col(version), F.col(low), F.col(high))).drop("_level", "_block")


def version_counts(points: DataFrame, ranges: DataFrame, version: str, low: str, high: str, item: str) -> DataFrame:
    """Each version that is in a range, with n, first_id and ids (the sum) of the ranges' items. Null bounds as in version_join.

    Items of the same bounds are counted before versions meet them, and no pair of a version and an item is made.
    """
    bounds = ranges.groupBy(low, high).agg(F.count(item).alias("_n"), F.min(item).alias("_first"), F.sum(item).alias("_ids"))
    met = version_join(points.select(version).distinct(), bounds, version, low, high)
    return met.groupBy(version).agg(F.sum("_n").alias("n"), F.min("_first").alias("first_id"), F.sum("_ids").alias("ids"))
