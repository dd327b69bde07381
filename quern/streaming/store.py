"""Tables that are replaced or merged as a whole, and the sinks of streams that keep them.

A table is a folder of versions, each written once, and a file that names the current one. The file is replaced by a rename, so a
reader gets one version or the next and never a mix; on stores whose rename isn't atomic use a table format instead. The file
names the last micro-batch of each stream too: a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quern.streaming.tasks import count_tasks, merge_tasks


class Table:
    """A stored table at path. keep: how many versions stay for readers that began before a replacement."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("_").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The versions that stay (the last is the current one), and the last batch of each stream."""
        place = self._path("_current")
        if not self._fs().exists(place):
            return {"versions": [], "batches": {}}
        stream = self._fs().open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The current version; None before the first."""
        versions = self.state()["versions"]
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def replace(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
        """Make rows the current version. One writer at a time: a stream's micro-batches, or a job."""
        state = self.state()
        version = f"v{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        versions = [*state["versions"], version]
        gone, versions = versions[: -self.keep], versions[-self.keep :]
        batches = state["batches"] | ({stream: batch} if stream is not None else {})
        temporary = self._path(f"_current-{version}")
        out = self._fs().create(temporary, True)
        out.write(bytearray(json.dumps({"versions": versions, "batches": batches}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._path("_current"), options)
        for old in gone:
            self._fs().delete(self._path(old), True)

    def done(self, stream: str, batch: int) -> bool:
        """Whether this batch of the stream is in the current version."""
        return self.state()["batches"].get(stream, -1) >= batch


def merge_batch(table: Table, counted: DataFrame, key: Sequence[str], stream: str, batch: int) -> bool:
    """Merge a micro-batch's counts into a task table, once. False where it was in the table already."""
    if table.done(stream, batch):
        return False
    old = table.read()
    new = counted.withColumn("status", F.lit("open")) if old is None else merge_tasks(old, counted, key)
    table.replace(new, stream, batch)
    return True


def keep_tasks(events: DataFrame, table: Table, key: Sequence[str], time: str, payload: str, checkpoint: str, stream: str = "tasks") -> StreamingQuery:
    """Count a stream's events into a task table; each micro-batch adds what it brings, whatever the order of events."""

    def sink(batch: DataFrame, number: int) -> None:
        merge_batch(table, count_tasks(batch, key, time, payload), key, stream, number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def close_tasks(table: Table, closed: DataFrame, key: Sequence[str], status: str = "resolved") -> None:
    """Set the status of the tasks whose keys closed names."""
    tasks = table.read()
    if tasks is not None:
        table.replace(tasks.join(closed.select(*key).distinct().withColumn("_closed", F.lit(True)), list(key), "left").withColumn("status", F.when(F.col("_closed"), status).otherwise(F.col("status"))).drop("_closed"))


def append_log(rows: DataFrame, path: str, time: str) -> None:
    """Add rows to a log dealt by day; nothing in it is ever changed."""
    rows.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def keep_log(rows: DataFrame, path: str, time: str, item: str, days: int, checkpoint: str) -> StreamingQuery:
    """Append a stream to such a log. A request that comes twice stays once, and one older than the retention isn't taken."""
    fresh = rows.withWatermark(time, f"{days} days").dropDuplicatesWithinWatermark([item])
    dated = fresh.withColumn("day", F.to_date(time))
    return dated.writeStream.option("checkpointLocation", checkpoint).option("path", path).partitionBy("day").format("parquet").outputMode("append").trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str, time: str, now, days: int) -> DataFrame:
    """The rows of the log within the retention; whole days before it aren't read."""
    since = F.lit(now) - F.expr(f"interval {days} days")
    return spark.read.parquet(path).where((F.col(time) > since) & (F.col("day") >= F.to_date(since))).drop("day")


def enrich(rows: DataFrame, table: Table, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Join a stream with a table that is read anew for each micro-batch; rows without a partner stay."""

    def each(batch: DataFrame, number: int) -> None:
        side = table.read()
        sink(batch if side is None else batch.join(side, key, "left"), number)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
