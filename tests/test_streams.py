"""Limits, task tables and logs as streams, against batch plans and plain folds."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import limits, store, tasks

T0 = 1_700_000_000


def plain_limit(rows, limit, seconds):
    """rows: key, item, microseconds, exempt."""
    span = seconds * 1_000_000
    state, out = {}, {}
    for key, item, s, free in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if free:
            out[item] = (True, None)
            continue
        start, n = state.get(key, (None, 0))
        if start is None or s - start >= span:
            start, n = s, 0
        n += 1
        state[key] = start, n
        out[item] = (n <= limit, None if n <= limit else max(1, -(-(start + span - s) // 1_000_000)))
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "k string, i string, s long, free boolean").withColumn("t", F.timestamp_micros("s"))


def some_requests(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(["key:a", "key:a", "key:a", "ip:b", f"ip:{rng.randint(0, 20)}"]), f"r{i:04}", T0 + rng.choice([rng.randint(0, 900), rng.randint(0, 90), rng.random() * 5000]), rng.random() < 0.05) for i in range(n)]
    return [(k, i, int(s * 1_000_000), f) for k, i, s, f in rows]


@pytest.mark.parametrize("limit,seconds", [(3, 60), (1, 60), (5, 7), (2, 1000)])
def test_batch_limit_equals_plain_fold(spark, limit, seconds):
    rows = some_requests(limit, 600)
    got = limits.limited(requests(spark, rows), "k", "t", "i", limit, seconds, F.col("free"))
    assert got.columns == ["k", "i", "allowed", "retry_after"]
    assert {r["i"]: (r["allowed"], r["retry_after"]) for r in got.collect()} == plain_limit(rows, limit, seconds)


def test_batch_limit_of_nothing(spark):
    assert limits.limited(requests(spark, []), "k", "t", "i", 3, 60).collect() == []


def test_stream_limit_equals_batch_on_shuffled_input(spark, tmp_path):
    rows = some_requests(9, 240)
    random.Random(1).shuffle(rows)
    end = [("key:end", "end", (T0 + 99_999) * 1_000_000, False)]
    later = [("key:end", "end2", (T0 + 199_999) * 1_000_000, False)]
    for n, part in enumerate([rows[:80], rows[80:160], rows[160:], end, later]):
        requests(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.ROCKSDB)
    try:
        source = spark.readStream.schema(requests(spark, end).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in*"))
        got = {}
        stream = limits.limit_stream(source, "k", "t", "i", 3, 60, "2 hours", F.col("free"))
        q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: got.update({r["item"]: (r["allowed"], r["retry_after"]) for r in b.collect()})).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = plain_limit(rows, 3, 60)
    assert {i: got.get(i) for i in want} == want


def test_keys_and_exemptions(spark):
    df = spark.createDataFrame([("k1", "1.1.1.1", "/x", None), ("", "1.1.1.1", "/health", ""), (None, None, "/healthy", "secret"), (None, "2.2.2.2", "/api/docs/x", None), (None, "2.2.2.2", None, "other")], "a string, ip string, p string, t string")
    got = df.select(limits.request_key(F.col("a"), F.col("ip")), limits.is_exempt(F.col("p"), F.col("t"), "secret"), limits.is_exempt(F.col("p"), F.col("t"), "")).collect()
    assert [tuple(r) for r in got] == [("key:k1", False, False), ("ip:1.1.1.1", True, True), ("ip:unknown", True, False), ("ip:2.2.2.2", True, True), ("ip:2.2.2.2", False, False)]


def test_task_table_from_a_stream(spark, tmp_path):
    """A replayed batch changes nothing, the stream equals the batch count, and closed tasks stay closed."""
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.randint(0, 3), i, rng.randint(0, 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "kind string, code int, item int, t int")
    key, table = ["kind", "code"], store.Table(spark, str(tmp_path / "tasks"))
    assert table.read() is None
    for n in range(3):
        df.where(F.col("item") % 4 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: store.keep_tasks(source(), table, key, "t", "item", str(tmp_path / "cp")).awaitTermination()
    run()
    whole = lambda part: {tuple(r) for r in tasks.count_tasks(part, key, "t", "item").collect()}
    now = lambda: {tuple(r) for r in table.read().drop("status").select("kind", "code", "occurrences", "created_at", "last_seen_at", "payload").collect()}
    assert now() == whole(df.where("item % 4 < 3"))
    before = table.state()
    assert before["batches"] == {"tasks": 2} and len(before["versions"]) == 2
    assert not store.merge_batch(table, tasks.count_tasks(df, key, "t", "item"), key, "tasks", 2)
    assert table.state() == before
    store.close_tasks(table, spark.createDataFrame([("x", 1)], "kind string, code int"), key)
    df.where(F.col("item") % 4 == 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert now() == whole(df)
    assert {(r["kind"], r["code"]): r["status"] for r in table.read().collect() if r["status"] != "open"} == {("x", 1): "resolved"}


def test_readers_see_one_version(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    table.replace(spark.range(10).withColumn("v", F.lit(1)))
    old = table.read()
    table.replace(spark.range(20).withColumn("v", F.lit(2)))
    assert (old.count(), old.agg(F.max("v")).first()[0]) == (10, 1)  # a reader that began before
    assert (table.read().count(), table.read().agg(F.min("v")).first()[0]) == (20, 2)
    table.replace(table.read().where("id < 5"))
    assert table.read().count() == 5 and len(list((tmp_path / "t").glob("v*"))) == 2
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception):
        table.replace(bad)
    assert table.read().count() == 5


def test_enriched_stream_reads_the_table_anew(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    side = lambda v: table.replace(spark.createDataFrame([(k, v) for k in range(3)], "k int, v int"))
    for n in range(2):
        spark.createDataFrame([(n,), (9,)], "k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def sink(batch, number):
        seen.append(sorted((r["k"], r["v"]) for r in batch.collect()))
        side(number + 2)

    side(1)
    source = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.enrich(source, table, "k", sink, str(tmp_path / "cp")).awaitTermination()
    assert sorted(len(s) for s in seen) == [2, 2] and [s[0][1] for s in seen] == [1, 2] and all(s[-1] == (9, None) for s in seen)


def test_log_keeps_each_request_once_and_drops_old_ones(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    schema = "id int, t timestamp, said string"
    for part in ([(1, day(40), "a"), (2, day(20), "b")], [(1, day(40), "a"), (3, day(41), "c")], [(5, day(42), "d"), (4, day(5), "too old")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store.keep_log(source, str(tmp_path / "log"), "t", "id", 30, str(tmp_path / "cp")).awaitTermination()
    ids = lambda now, days: sorted(r["id"] for r in store.read_log(spark, str(tmp_path / "log"), "t", now, days).collect())
    assert ids(day(45), 300) == [1, 2, 3, 5] and ids(day(45), 5) == [3, 5]
    store.append_log(spark.createDataFrame([(9, day(44), "e")], schema), str(tmp_path / "audit"), "t")
    store.append_log(spark.createDataFrame([(9, day(44), "e")], schema), str(tmp_path / "audit"), "t")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
