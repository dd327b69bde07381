"""URL rules by Bloom filter cascades: exact membership of every key of a corpus in lists of keys, without a join.

A rule is a host and a path; its key is both together. It fits a URL if it's among the URL's keys: each suffix of its host
at a dot, with each prefix of its path (of the shapes, labels and path length, that some rule has). Of the listed keys a
cascade's first level holds all. Its false positives over all keys of the corpus go into the second level, listed keys
that the second level wrongly has into the third, and so on until none is left. A key is listed if the first level that lacks it
is an even one (counted from 1). For the corpus the cascade was built over this is exact; for other URLs it errs like a Bloom filter.

Building reads the corpus once for the first level's false positives; only they, a set about as large as the list, meet
the list exactly. The levels have a known size, about 1.44 bits a key and halving of the errors, and are broadcast if they
fit `most_bytes`; for a larger list the same keys are looked up by a join.

A null URL or one without `://` has an empty host and path and fits no rule. Rules without a host, a path or an action are
ignored; of rules with one key the block holds; the longest key wins, of equally long ones that with the longer host.
Repeated URLs give a row each; an empty table gives no row; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import Scratch, table
from quern.llm.textvec import mix

#: The query's rules, host, path and action.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL that have one of the shapes: array of (key, labels)."""
    all_ = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in shapes])
    fitting = F.filter(all_, lambda s: (host != "") & (s["n"] <= labels_of(host)) & (s["p"] <= F.length(path)))
    key = lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["n"]), F.substring(path, F.lit(1), s["p"]))
    return F.transform(fitting, lambda s: F.struct(key(s).alias("key"), s["n"].alias("n")))


def hashed(key: Column) -> list[Column]:
    """Two hashes of a key; what tells keys apart in a cascade."""
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


@dataclass
class Cascade:
    """Bloom filters as (bits, hashes a key), the first holding the listed keys."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    @staticmethod
    def positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
            b = mix(h2.view(np.uint64) ^ a) | np.uint64(1)
            for k in range(hashes):
                yield (a + np.uint64(k) * b) % np.uint64(size)

    @classmethod
    def filter_size(cls, n: int, rate: float) -> tuple[int, int]:
        """Bits and hashes of a filter of n keys with about this rate of errors."""
        hashes = max(1, round(-math.log2(rate)))
        return max(64, math.ceil(hashes * n / math.log(2))), hashes

    def has(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        bits, hashes = self.levels[level]
        found = np.ones(len(h1), dtype=bool)
        for at in self.positions(h1, h2, level, len(bits) * 8, hashes):
            found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), dtype=bool)
        inside = np.arange(len(h1))
        for level in range(len(self.levels)):
            inside = inside[self.has(h1[inside], h2[inside], level)]
            out[inside] = level % 2 == 0
            if not len(inside):
                break
        return out

    @property
    def n_bytes(self) -> int:
        return sum(len(bits) for bits, _ in self.levels)


def _level_bits(keys: DataFrame, level: int, rate: float) -> tuple[np.ndarray, int]:
    """A filter of the keys (h1, h2): tasks set bits, Spark unites them by byte."""
    size, hashes = Cascade.filter_size(keys.count(), rate)
    size = -(-size // 8) * 8

    def set_bits(batches):
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            at = np.unique(np.concatenate(list(Cascade.positions(h1, h2, level, size, hashes)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(1 << (at & 7))], ["i", "bit"])

    cells = keys.select("h1", "h2").mapInArrow(set_bits, "i long, bit long").groupBy("i").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(size // 8, dtype=np.uint8)
    bits[cells["i"].to_numpy()] = cells["bit"].to_numpy()
    return bits, hashes


def _inside(keys: DataFrame, shared: Broadcast, level: int) -> DataFrame:
    """The rows of keys (h1, h2) that the level holds."""

    def held(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), level)))

    return keys.mapInArrow(held, keys.schema)


def build(listed: DataFrame, universe: DataFrame, scratch: Scratch, first_rate: float = 2.0**-8, rate: float = 0.5, most_bytes: int = 1 << 27, most_levels: int = 100) -> Cascade | None:
    """The cascade of the keys listed (h1, h2, distinct) over universe (h1, h2; repeats are fine). None if it passes most_bytes."""
    spark = listed.sparkSession
    cascade = Cascade()
    inside, outside, stays = listed, None, rate
    n = listed.count()
    for level in range(most_levels):
        this_rate = rate if level else first_rate
        if n == 0:
            return cascade
        if cascade.n_bytes + Cascade.filter_size(n, this_rate)[0] // 8 > most_bytes:
            return None
        cascade.levels.append(_level_bits(inside, level, this_rate))
        shared = spark.sparkContext.broadcast(cascade)
        if level == 0:
            wrong = _inside(universe, shared, 0).distinct().join(listed, ["h1", "h2"], "left_anti")
        else:
            wrong = _inside(outside, shared, level)
        wrong = scratch.stored(wrong, "errors")
        shared.unpersist()
        inside, outside, n = wrong, inside, wrong.count()
    raise RuntimeError(f"keys are still mixed up after {most_levels} levels")


def _members(urls: DataFrame, cascades: list[Broadcast]) -> DataFrame:
    """urls (_id fields, keys) with the places in keys that each cascade lists, as arrays of booleans."""

    def judged(batches):
        for batch in batches:
            keys = batch.column("hashes")
            flat = keys.flatten()
            h1, h2 = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets = pa.array(np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32))
            found = [pa.ListArray.from_arrays(offsets, pa.array(c.value.member(h1, h2))) for c in cascades]
            yield pa.RecordBatch.from_arrays([batch.column("_url"), *found], ["_url", *(f"in{i}" for i in range(len(found)))])

    kind = urls.schema["_url"].dataType.simpleString()
    return urls.mapInArrow(judged, f"_url {kind}, " + ", ".join(f"in{i} array<boolean>" for i in range(len(cascades))))


def judge_urls(pages: DataFrame, rules: DataFrame, scratch: Scratch, id_col: str = "page_id", default: str = "allow", most_bytes: int = 1 << 27, most_shapes: int = 4096) -> DataFrame:
    """id_col, url, host, path, rule, verdict of each row of pages. rules: host, path, action (allow or block).

    A URL that fits no rule is on neither list: its verdict is `default`.
    """
    listed = rules.where("host is not null and host != '' and path is not null and action in ('allow', 'block')")
    listed = listed.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "action").withColumn("key", F.concat("host", "path")).withColumn("n", labels_of(F.col("host")))
    listed = scratch.stored(listed.groupBy("key", "n").agg(F.max("action").alias("action"), F.first(F.length("path")).alias("p")), "rules", keep=True)
    # Shapes are few: labels of a host by lengths of a path, however many rules there are.
    shapes = sorted((r["n"], r["p"]) for r in listed.select("n", "p").distinct().limit(most_shapes + 1).collect())
    if len(shapes) > most_shapes:
        raise ValueError(f"the rules have over {most_shapes} shapes (labels of the host, length of the path)")
    here = pages.select(F.col(id_col), F.col("url").cast("string").alias("url"))
    host, path = F.col("host"), F.col("path")
    here = here.select(id_col, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return here.select(id_col, "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tagged = lambda k: F.concat(k["key"], F.lit("\x00"), k["n"].cast("string"))  # noqa: E731  a key's labels tell equal strings of other cuts apart
    keys = keys_of(host, path, shapes)
    universe = here.select(F.explode(keys).alias("k")).select(*hashed(tagged(F.col("k"))))
    actions = ["allow", "block"]
    cascades = [build(scratch.stored(listed.where(F.col("action") == a).select(*hashed(tagged(F.struct("key", "n")))), "listed"), universe, scratch, most_bytes=most_bytes) for a in actions]
    if any(c is None for c in cascades):
        return _joined(here, keys, listed, id_col, default)
    sent = [here.sparkSession.sparkContext.broadcast(c) for c in cascades]
    hashes = F.transform(keys, lambda k: F.struct(*hashed(tagged(k))))
    url = F.struct(id_col, "url", "host", "path")
    found = _members(here.select(url.alias("_url"), hashes.alias("hashes")), sent).select("_url.*", "in0", "in1")
    flagged = F.arrays_zip(keys.alias("k"), F.col("in0").alias("allow"), F.col("in1").alias("block"))
    flagged = F.filter(flagged, lambda x: x["allow"] | x["block"])
    best = F.array_max(F.transform(flagged, lambda x: F.struct(F.length(x["k"]["key"]).alias("size"), F.length(F.call_function("substring_index", host, F.lit("."), -x["k"]["n"])).alias("width"), x["k"]["key"].alias("key"), F.when(x["block"], "block").otherwise("allow").alias("action"))))
    return found.withColumn("_best", best).select(id_col, "url", "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def _joined(here: DataFrame, keys: Column, listed: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same by a join of keys, for lists whose filters would be too large to broadcast."""
    rows = here.withColumn("_row", F.monotonically_increasing_id())
    url = F.struct(id_col, "url", "host", "path")
    one = rows.select("_row", url.alias("_url"), F.explode_outer(keys).alias("k")).select("_row", "_url", "k.key", "k.n")
    width = F.length(F.call_function("substring_index", F.col("_url.host"), F.lit("."), -F.col("n")))
    best = F.max(F.when(F.col("action").isNotNull(), F.struct(F.length("key").alias("size"), width.alias("width"), "key", "action")))
    found = one.join(listed.select("key", "n", "action"), ["key", "n"], "left").groupBy("_row").agg(F.first("_url").alias("_url"), best.alias("_best"))
    return found.select("_url.*", F.col("_best.key").alias("rule"), F.coalesce("_best.action", F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    with Scratch(spark) as scratch:
        return judge_urls(table(spark, sf_dir, "pages"), rules, scratch).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
#: Each URL against each rule, the longest that fits.
OP11_SQL = f"""
WITH rules(rh, rp, action) AS (VALUES {_RULE_ROWS}),
urls AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
best AS (
  SELECT page_id, url, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, url)
SELECT u.page_id, u.host, u.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON b.page_id IS NOT DISTINCT FROM u.page_id AND b.url IS NOT DISTINCT FROM u.url
"""
