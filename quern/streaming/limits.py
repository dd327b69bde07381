"""Fixed-window rate limits per key, as a stateful stream and as a batch plan that gives the same answers.

A key's window opens at its first request after the last window and lasts a fixed time. Requests beyond the limit in
it are rejected and told after how many seconds the window ends (1 at least). Exempt requests are always allowed and don't count.
Requests of one key and time are ordered by item, which tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.operators.catalogue import checkpointed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_key(api_key: Column, ip: Column) -> Column:
    """Whose requests are counted together: an API key's, else an address's."""
    return F.when(api_key != "", F.concat(F.lit("key:"), api_key)).otherwise(F.concat(F.lit("ip:"), F.coalesce(ip, F.lit("unknown"))))


def is_exempt(path: Column, token: Column, admin_token: str, prefixes: Sequence[str] = ("/health", "/api/docs")) -> Column:
    """Paths that are or lie under a prefix, and requests that carry the admin token (where there is one)."""
    under = F.lit(False)
    for p in prefixes:
        under = under | (path == p) | F.startswith(path, F.lit(f"{p}/"))
    return F.coalesce(under, F.lit(False)) | F.coalesce(token == admin_token if admin_token else F.lit(False), F.lit(False))


def _retry_after(us: Column, start: Column, seconds: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((start + seconds * 1_000_000 - us) / 1_000_000)).cast("long")


def _next_times(times: DataFrame, span: int) -> DataFrame:
    """key, us and to: for each time the key's first time that is span or more later (null: none).

    Times are dealt to buckets of span. The time asked for lies in the next bucket, or is the first one of the next bucket but one
    that isn't empty, so no key is read as a whole; a bucket has at most span different times.
    """
    bucket = F.floor(F.col("us") / span)
    own = times.select("key", "us", bucket.alias("bucket"))
    seen = own.select("key", "bucket", F.col("us").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("us"))
    probe = own.select("key", (F.col("bucket") + 1).alias("bucket"), (F.col("us") + span).alias("at"), F.lit(0).alias("kind"), "us")
    # From the last time to the first: a frame that grows is kept up row by row, one that shrinks is read anew for each row.
    ahead = W.partitionBy("key", "bucket").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    near = seen.unionByName(probe).withColumn("to", F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(ahead)).where("kind = 0").select("key", "us", F.col("bucket") - 1, "to").toDF("key", "us", "bucket", "near")
    in_order = W.partitionBy("key").orderBy("bucket")
    firsts = own.groupBy("key", "bucket").agg(F.min("us").alias("first"))
    firsts = firsts.select("key", "bucket", *[F.lead(c, n).over(in_order).alias(f"{c}{n}") for c in ("bucket", "first") for n in (1, 2)])
    later = F.when(F.col("bucket1") == F.col("bucket") + 1, F.col("first2")).otherwise(F.col("first1"))
    return near.join(firsts, ["key", "bucket"]).select("key", "us", F.coalesce("near", later).alias("to"))


def window_starts(times: DataFrame, span: int) -> DataFrame:
    """key and us of the times at which windows open, of times (key, us).

    The first time of a key opens one, and each window leads to the next. Pointers are doubled: after n rounds a pointer leads 2**n
    windows on, and the windows found so far find as many again, so a key with n windows takes about log n rounds.
    """
    times = checkpointed(times.select("key", "us").distinct())
    to = checkpointed(_next_times(times, span).where("to is not null"))
    found = checkpointed(times.groupBy("key").agg(F.min("us").alias("us")))
    while True:
        reached = checkpointed(found.join(to, ["key", "us"]).select("key", F.col("to").alias("us")))
        if reached.isEmpty():
            return found
        found = checkpointed(found.unionByName(reached).distinct())
        onward = to.select("key", F.col("us").alias("to"), F.col("to").alias("further"))
        to = checkpointed(to.join(onward, ["key", "to"]).select("key", "us", F.col("further").alias("to")))


def limited(requests: DataFrame, key: str, time: str, item: str, limit: int, seconds: int, exempt: Column | None = None) -> DataFrame:
    """key, item, allowed and retry_after (seconds; of rejected requests) of each request. A key with most of the requests is no
    task of its own: windows are found by pointers, and a window's first requests by a top-k that each task starts on its own."""
    span = seconds * 1_000_000
    rows = requests.select(F.col(key).alias("key"), F.col(item).alias("item"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), F.coalesce(F.lit(False) if exempt is None else exempt, F.lit(False)).alias("exempt"))
    free, counted = rows.where("exempt"), rows.where("not exempt").withColumn("bucket", F.floor(F.col("us") / span))
    starts = window_starts(counted, span)
    bucket = F.floor(F.col("us") / span)
    # A bucket sees at most two windows: one that opened in the bucket before, and its own.
    sides = starts.select("key", bucket.alias("bucket"), F.col("us").alias("own"), F.lit(None).cast("long").alias("old")).unionByName(starts.select("key", (bucket + 1).alias("bucket"), F.lit(None).cast("long").alias("own"), F.col("us").alias("old")))
    sides = sides.groupBy("key", "bucket").agg(F.max("own").alias("own"), F.max("old").alias("old"))
    placed = counted.join(sides, ["key", "bucket"]).select("key", "item", "us", F.when(F.col("own") <= F.col("us"), F.col("own")).otherwise(F.col("old")).alias("start"))
    first = placed.withColumn("n", F.row_number().over(W.partitionBy("key", "start").orderBy("us", "item"))).where(F.col("n") <= limit)
    last = first.where(F.col("n") == limit).select("key", "start", F.struct("us", "item").alias("last"))
    within = F.col("last").isNull() | (F.struct("us", "item") <= F.col("last"))
    judged = placed.join(last, ["key", "start"], "left").select("key", "item", within.alias("allowed"), F.when(~within, _retry_after(F.col("us"), F.col("start"), seconds)).alias("retry_after"))
    out = judged.unionByName(free.select("key", "item", F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_after")))
    return out.withColumnsRenamed({"key": key, "item": item})


class _Limiter(StatefulProcessor):
    """A key's open window, and its requests that wait until the watermark has passed them, so that order doesn't matter."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n long")
        self.waiting = handle.getListState("waiting", "us long, item string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["us"].tolist(), pdf["item"].tolist())))
            latest = max(latest, int(pdf["us"].max()))
        self.handle.registerTimer(latest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        start, n = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for us, item in (h for h in held if h[0] <= mark):
            if start is None or us - start >= self.span:
                start, n = us, 0
            n += 1
            out.append((key[0], item, n <= self.limit, 0 if n <= self.limit else max(1, -(-(start + self.span - us) // 1_000_000))))
        rest = [h for h in held if h[0] > mark]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if start is not None:
            if rest or mark < start + self.span:
                self.window.update((start, n))
                self.handle.registerTimer((start + self.span) // 1000 + 1)  # an idle key's state goes then
            else:
                self.window.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "item", "allowed", "retry_after"])

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, key: str, time: str, item: str, limit: int, seconds: int, delay: str, exempt: Column | None = None) -> DataFrame:
    """The stream of answers to a stream of requests that come at most `delay` late: key, item, allowed, retry_after.

    Exempt requests pass through without state. The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    rows = requests.withColumn("_free", F.coalesce(F.lit(False) if exempt is None else exempt, F.lit(False)))
    free = rows.where("_free").select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.lit(True).alias("allowed"), F.lit(None).cast("long").alias("retry_after"))
    counted = rows.where("not _free").select(F.col(key).alias("key"), F.col(item).cast("string").alias("item"), F.unix_micros(time).alias("us"), F.col(time).alias("_time")).withWatermark("_time", delay)
    judged = counted.groupBy("key").transformWithStateInPandas(_Limiter(limit, seconds), "key string, item string, allowed boolean, retry_after long", "Append", "EventTime")
    return judged.withColumn("retry_after", F.nullif("retry_after", F.lit(0).cast("long"))).unionByName(free)
