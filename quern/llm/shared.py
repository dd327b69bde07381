"""Helpers that the operators of this package share: tables, shared storage, seeded hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 form of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset in local mode (tests) a temporary folder takes its place; on a cluster that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the session's own folder, which release removes."""
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Remove all that this session's operators keep on shared storage; their results can't be read any more."""
    _delete(spark, f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to shared storage and read it again, which cuts its lineage. It stays until release."""
    return Scratch(df.sparkSession).stored(df, what)


class Scratch:
    """Frames on shared storage that one job makes: removed when the job ends or fails, but for those its result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed, *_) -> None:
        for path in self.paths:
            if failed or path not in self.kept:
                _delete(self.spark, path)

    def stored(self, df: DataFrame, what: str, keep: bool = False) -> DataFrame:
        """df, written and read again; keep: the result reads it."""
        path = new_path(self.spark, what)
        self.paths.append(path)
        if keep:
            self.kept.add(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts don't add up.

    The setting stays for the session: results are lazy and run after their operator has returned.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that share a key."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = t[key].to_numpy()
        cut = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for lo, hi in zip([0, *cut[:-1]], cut):
            yield t.slice(lo, hi - lo).combine_chunks()
        held = t.slice(cut[-1]) if cut else t
    if held is not None:
        yield held.combine_chunks()


def id_fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, mod a number; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def one_label(labels: DataFrame, value: str, pick) -> DataFrame:
    """One row per doc_id: repeated labels are merged by pick (min or max), null ones ignored."""
    return labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(pick(F.col(value).cast("int")).alias("label"))


def seeded_sample(labels: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most limit labelled ids, those with the smallest seeded hash: the same in each run."""
    return labels.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")).limit(limit)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt evenly over the shuffle partitions by a hash of keys, for heavy work per row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
