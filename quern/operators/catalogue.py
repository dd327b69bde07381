"""Catalogue operators: unique keys, consensus, invariants, merges, diffs and rankings as DataFrame plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique_keys(rows: DataFrame, key: Column, owner: str) -> DataFrame:
    """key and owner of the keys that one owner alone has."""
    return rows.select(key.alias("key"), owner).where(F.col("key").isNotNull()).groupBy("key").agg(F.min(owner).alias(owner), F.max(owner).alias("_last")).where(F.col(owner) == F.col("_last")).drop("_last")


def collisions(rows: DataFrame, key: Column, owner: str) -> DataFrame:
    """Keys that several owners have, with the number of owners."""
    return rows.select(key.alias("key"), owner).where(F.col("key").isNotNull()).distinct().groupBy("key").agg(F.count("*").alias("owners")).where("owners > 1")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The value with most votes in each group; null where several have as many, or none voted."""
    votes = rows.groupBy(group, value).agg(F.count(value).alias("n"))
    top = votes.groupBy(group).agg(F.max(F.when(F.col("n") > 0, F.struct("n", value))).alias("best"), F.collect_list("n").alias("counts"))
    alone = F.size(F.filter("counts", lambda n: n == F.col("best.n"))) == 1
    return top.select(group, F.when(alone, F.col(f"best.{value}")).alias(value))


def one_per_source(rows: DataFrame, group: str, source: str, order: Sequence[str]) -> DataFrame:
    """The first row of each group and source, by one aggregation instead of a window."""
    rest = [c for c in rows.columns if c not in (group, source)]
    first = rows.groupBy(group, source).agg(F.min(F.struct(*order, F.struct(*[c for c in rest if c not in order]).alias("_rest"))).alias("_first"))
    return first.select(group, source, *[F.col(f"_first.{c}") if c in order else F.col(f"_first._rest.{c}") for c in rest])


def consensus(votes: DataFrame, group: str, support: str) -> DataFrame:
    """Outcome and status of each group, from one vote of each source; unknown abstains."""
    n = lambda v: F.count_if(F.col(support) == v)
    counted = votes.groupBy(group).agg(n("supported").alias("yes"), n("not_supported").alias("no"), n("conditional").alias("maybe"))
    total, kinds = F.col("yes") + F.col("no") + F.col("maybe"), sum((F.col(c) > 0).cast("int") for c in ("yes", "no", "maybe"))
    one = F.when(F.col("yes") > 0, "supported").when(F.col("no") > 0, "not_supported").otherwise("conditional")
    outcome = F.when(total == 0, "no-data").when(total == 1, "single-source").when(kinds == 1, "unanimous").when(F.col("maybe") > 0, "caution-rule").otherwise("quarantined")
    status = F.when(outcome.isin("single-source", "unanimous"), one).when(outcome == "caution-rule", "conditional")
    return counted.select(group, outcome.alias("outcome"), status.alias("status"), total.alias("agreement_count"))


def set_consensus(status: Column) -> Column:
    """The one status of a group, else mixed."""
    return F.when(F.min(status) == F.max(status), F.min(status)).otherwise("mixed")


def merge_override(base: DataFrame, patch: DataFrame, key: str, fields: Sequence[str], nested: Mapping[str, Sequence[str]] | None = None, keep_null: Sequence[str] = ()) -> DataFrame:
    """base with the fields that patch sets (its `set` array names them), null values too.

    nested: the parts of struct fields, which are replaced one by one; set names them as field.part. A null part changes nothing,
    but for those in keep_null, for which null is a value.
    """
    nested = nested or {}
    p = patch.select(F.col(key), "set", *[F.col(f).alias(f"_new_{f}") for f in (*fields, *nested)])
    joined = base.join(p, key, "left")
    has = lambda f: F.coalesce(F.array_contains("set", f), F.lit(False))
    changed = {f: F.when(has(f), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    for f, parts in nested.items():
        old, new = (lambda n, f=f: F.col(f)[n]), (lambda n, f=f: F.col(f"_new_{f}")[n])
        changed[f] = F.struct(*[F.when(has(f"{f}.{n}"), new(n) if f"{f}.{n}" in keep_null else F.coalesce(new(n), old(n))).otherwise(old(n)).alias(n) for n in parts])
    return joined.withColumns(changed).drop("set", *[f"_new_{f}" for f in (*fields, *nested)])


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and change: added, removed, or changed in one of fields."""
    o, n = (d.select(key, F.struct(*fields).alias(a)) for d, a in ((old, "_old"), (new, "_new")))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """new over old by key; the first creation time stays, and nothing is deleted."""
    fields = [c for c in new.columns if c not in (key, created)]
    o = old.select(key, F.col(created).alias("_created"), F.struct(*fields).alias("_old"))
    n = new.select(key, F.col(created).alias("_now"), F.struct(*fields).alias("_new"))
    return o.join(n, key, "full_outer").select(key, F.coalesce("_created", "_now").alias(created), F.coalesce("_new", "_old").alias("_row")).select(key, created, "_row.*")


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def shared_trigrams(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: Column, right_text: Column, least: int = 1) -> DataFrame:
    """Pairs of ids and how many of the left text's trigrams, repeated ones too, the right text has, by an inverted index."""
    from quern.functions.text import trigrams

    a = left.select(left_id, F.explode(trigrams(left_text)).alias("gram"))
    b = right.select(right_id, F.explode(F.array_distinct(trigrams(right_text))).alias("gram"))
    return a.join(b, "gram").groupBy(left_id, right_id).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def decide(scored: DataFrame, query: str, item: str, score: str, sure: float, gap: float, order: Sequence[Column] = (), key: str | None = None, clear: Column | None = None, narrower: Column | None = None, asked: DataFrame | None = None, n: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """One row per query: its leader, the leader's distance from the second, and the outcome.

    order: columns that break ties of scores before the item. key: where all candidates as near to the leader as gap
    (all ranked ones if the leader isn't sure) share one key, and clear holds, the outcome is RESOLVED_BY_EQUIVALENCE; a
    null key equals none. narrower: a single leader that is narrower than its query is open (GAP_TOO_SMALL). asked: all
    queries; those without a candidate are NOT_FOUND. n: how many items a row stands for, which are alike but for the item (the
    row has the first). also: columns of the leader to return.
    """
    rank, whole = W.partitionBy(query).orderBy(F.desc(score), *order, F.asc(item)), W.partitionBy(query)
    ranked = scored.withColumn("_rank", F.row_number().over(rank)).withColumn("_next", F.lead(score).over(rank))
    if n is not None:
        ranked = ranked.withColumn("_next", F.when(F.col(n) > 1, F.col(score)).otherwise(F.col("_next")))
    if key is not None:
        top = F.max(score).over(whole)
        ranked = ranked.withColumn("_near", (top < sure) | (top - F.col(score) < gap)).withColumn("_key", F.when(F.col("_near"), F.col(key)))
        rows = F.count_if("_near").over(whole)
        items = rows if n is None else F.sum(F.when(F.col("_near"), F.col(n))).over(whole)
        same = (F.count("_key").over(whole) == rows) & F.min("_key").over(whole).eqNullSafe(F.max("_key").over(whole))
        ranked = ranked.withColumn("_same", same & F.coalesce(F.lit(True) if clear is None else clear, F.lit(False))).withColumn("_several", items > 1)
    ranked = ranked.where("_rank = 1")
    lead = F.col(score) - F.coalesce("_next", F.lit(0.0))
    apart = (F.col(score) >= sure) & (lead >= gap)
    outcome = F.when(apart, "DETERMINED")
    if key is not None:
        outcome = outcome.when(F.col("_same"), "RESOLVED_BY_EQUIVALENCE")
    outcome = outcome.when(F.col(score) < sure, "BELOW_THRESHOLD").otherwise("GAP_TOO_SMALL")
    if narrower is not None:
        alone = apart | (F.col("_same") & ~F.col("_several")) if key is not None else apart
        outcome = F.when(alone & narrower, "GAP_TOO_SMALL").otherwise(outcome)
    out = ranked.select(query, F.col(item).alias("leader"), F.col(score), lead.alias("lead"), outcome.alias("outcome"), *also)
    return out if asked is None else asked.select(query).join(out, query, "left").withColumn("outcome", F.coalesce("outcome", F.lit("NOT_FOUND")))


def gate(total: int, rejected: int, most: float = 0.2) -> None:
    """Refuse to go on where too large a share was rejected."""
    if total + rejected and rejected / (total + rejected) > most:
        raise ValueError(f"{rejected} of {total + rejected} rows were rejected; at most {most:.0%} may be")


def prefix_suggestions(asked: DataFrame, items: DataFrame, query: str, item: str, code: str, least: int = 4, k: int = 5) -> DataFrame:
    """The k items whose codes share the longest prefix, of `least` or more, with each asked code; ties by item.

    Each prefix keeps its k smallest items. An item that belongs to the answer is among those of the prefix it
    shares, since whatever stands before it there stands before it in the answer too. So no pairs of codes are made.
    """
    prefixes = F.explode(F.transform(F.when(F.length(code) >= least, F.sequence(F.lit(least), F.length(code))).otherwise(F.array().cast("array<int>")), lambda i: F.left(F.col(code), i))).alias("prefix")
    index = top_k(items.select(item, prefixes).distinct(), ["prefix"], [F.asc(item)], k).drop("rank")
    found = asked.select(query, prefixes).join(index, "prefix").groupBy(query, item).agg(F.max(F.length("prefix")).alias("shared"))
    return top_k(found, [query], [F.desc("shared"), F.asc(item)], k)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written as Parquet to the session's folder in spark.checkpoint.dir, and read again.

    checkpoint() would keep the estimated size of the plan that made df. A join multiplies those of its sides, so rounds that
    build on each other had estimates of millions of digits; files have a size of their own.
    """
    return _written(df, _new_path(df.sparkSession))


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/kept-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def components(keyed: DataFrame, node: str, key: str) -> DataFrame:
    """The smallest node that each node reaches over shared keys, by rounds of minima that halve paths.

    Each round goes from nodes to keys and back, by aggregations alone, and then to the label of the label. Rounds
    end when none changes; labels are written each round, and removed when the next ones are there.
    """
    spark = keyed.sparkSession
    at, links_at = _new_path(spark), _new_path(spark)
    links = _written(keyed.select(node, key).where(F.col(key).isNotNull()).distinct(), links_at)
    labels = _written(keyed.select(node).distinct().withColumn("component", F.col(node)), at)
    while True:
        low = links.join(labels, node).groupBy(key).agg(F.min("component").alias("low"))
        near = links.join(low, key).groupBy(node).agg(F.min("low").alias("low"))
        step = labels.join(near, node, "left").select(node, F.col("component").alias("before"), F.least("component", "low").alias("component"))
        onward = step.select(F.col(node).alias("component"), F.col("component").alias("onward"))
        to = _new_path(spark)
        new = _written(step.join(onward, "component", "left").select(node, "before", F.least("component", "onward").alias("component")), to)
        _removed(spark, at)
        at = to
        if new.where("before <> component").isEmpty():
            _removed(spark, links_at)
            return new.drop("before")
        labels = new.drop("before")


def first_examples(rows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The size of each group and its k smallest items."""
    few = top_k(rows, [group], [F.asc(item)], k).groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("examples"))
    return rows.groupBy(group).agg(F.count("*").alias("total")).join(few, group)


def category_metrics(rows: DataFrame, category: str, expected: str, given: str, positive: str, open_: str) -> DataFrame:
    """Counts of right, wrongly positive and open answers by category and in total, and the percentage of right ones."""
    n = F.count_if
    counted = rows.rollup(category).agg(F.count("*").alias("total"), n(F.col(expected) == F.col(given)).alias("correct"), n((F.col(given) == positive) & (F.col(expected) != positive)).alias("false_positive"), n(F.col(given) == open_).alias("unanswered"))
    tenths = F.expr("(2000 * correct + total) div (2 * total)")
    percent = F.when(F.col("total") == 0, "—").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return counted.where("total > 0").withColumn(category, F.coalesce(category, F.lit("total"))).withColumn("percent", percent)


def exported(rows: DataFrame, origin: str, prefix: str, fields: Sequence[str]) -> DataFrame:
    """Rows whose origin starts with prefix, as one JSON document each; write with .text for files."""
    return rows.where(F.startswith(origin, F.lit(prefix))).select(fields[0], F.to_json(F.struct(*fields)).alias("document"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """version (12 hex digits) and n of a set of keys, whatever their order.

    Keys are dealt to 65,536 groups by a digest, each group's sorted keys are hashed, and then the hashes in the order of groups,
    so that one task never holds all keys. The value differs from a hash of all sorted keys at once.
    """
    groups = rows.groupBy(F.left(F.md5(F.col(key).cast("binary")), F.lit(4)).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "|"), 256).alias("h"), F.count("*").alias("n"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"])  # 65,536 at most
    return groups.agg(F.left(F.sha2(F.array_join(every, "|"), 256), F.lit(12)).alias("version"), F.sum("n").alias("n"))
