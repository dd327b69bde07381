"""Best-fit-decreasing packing of token sequences, exact at any size.

A document's ids (with the end id) longer than a sequence are cut into full pieces, of which the first may be
shorter. Best-fit decreasing needs only how many pieces of each length there are: lengths are integers up to
the capacity, so open bins of the same remaining capacity are interchangeable. The driver gets one count per
length (at most `capacity` rows whatever the input), and places whole runs of equal pieces at once: a segment
tree over remaining capacities, whose leaves count open bins, finds the tightest bin that fits in logarithmic
time. The plan is a list of runs (length, first rank, bin, offset), whose number depends on the capacity and
not on the input. Each piece's rank among those of its length comes from salted windows, so that a length held by a
third of all pieces spreads over many tasks; the rank finds its run by binary search.

The ids themselves go with their pieces (up to the last step as little-endian bytes, two an id where all of a batch
fit), so that a sequence is its pieces' ids in the order of offset. Checksums are taken from the ids returned.

Null and empty texts are one piece of the end id alone. Repeated rows are packed once each. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import small_batches, stored, table
from quern.llm.textvec import buffers
from quern.llm.token_counts import TOKENIZER
from quern.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open bins by remaining capacity: a segment tree of counts, and queues of runs (first bin, number)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _add(self, remaining: int, n: int) -> None:
        i = remaining + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def push(self, remaining: int, first: int, n: int) -> None:
        if remaining:
            self.runs[remaining].append((first, n))
            self._add(remaining, n)

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least length that some open bin has."""
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def pop(self, remaining: int, most: int) -> tuple[int, int]:
        first, n = self.runs[remaining].popleft()
        take = min(n, most)
        if take < n:
            self.runs[remaining].appendleft((first + take, n - take))
        self._add(remaining, -take)
        return first, take


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first bin, offset) of best-fit decreasing, and the number of bins.

    The pieces of a length with ranks from a run's first to the next run's go to consecutive bins.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = bins.tightest(length)
            if remaining is None:  # as many new bins as the pieces need, each filled with this length
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each):
                    n = full + (k < rest)
                    if n:
                        runs.append((length, rank, opened, k * length))
                        rank += n
                if full:
                    bins.push(capacity - each * length, opened, full)
                if rest:
                    bins.push(capacity - rest * length, opened + full, 1)
                    # the last bin holds `rest` pieces: those with k < rest went one bin further
                opened += full + (rest > 0)
                left = 0
            else:
                # After a piece the tightest bin is the one just used, as long as it fits: each takes all it can hold.
                each = min(remaining // length, left)
                first, n = bins.pop(remaining, left // each)
                for k in range(each):
                    runs.append((length, rank, first, capacity - remaining + k * length))
                    rank += n
                bins.push(remaining - each * length, first, n)
                left -= each * n
    return runs, opened


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    own = encoder(tokenizer)
    for batch in batches:
        ids, row = batch.column("doc_id"), 0
        for flat, begin in own.ids(batch.column("text")):
            docs = np.insert(flat.astype("<u4", copy=False), begin[1:], end_id)  # the end id behind each document
            ends = begin[1:] + np.arange(1, len(begin))
            rows = {k: [] for k in ("row", "piece", "start", "length")}
            for i, n in enumerate(np.diff(ends, prepend=0).tolist()):
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, x in zip(rows, (row + i, k, a, b - a)):
                        rows[name].append(x)
            row += len(begin) - 1
            places = 4 * np.cumsum([0, *rows["length"]])  # pieces follow each other without gaps
            crc = np.array([zlib.crc32(docs[a // 4 : b // 4]) for a, b in zip(places, places[1:])], dtype=np.int64)
            width = 2 if docs.max(initial=0) < 1 << 16 else 4
            held = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places // 4 * width).astype(np.int32)), pa.py_buffer(docs.astype(f"<u{width}"))])
            arrays = [ids.take(pa.array(rows["row"], pa.int64())), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()), pa.array(rows["length"], pa.int64()), held, pa.array(crc ^ np.array(rows["start"], dtype=np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids", "salt"])


def _placed(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """runs: (length, rank, bin, offset) in (length, rank) order."""
    key = (runs[:, 0] << 44) | runs[:, 1]
    for batch in batches:
        t = {n: batch.column(n) for n in batch.schema.names}
        length, rank = t["length"].to_numpy(), t.pop("rank").to_numpy()
        at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
        data, off = buffers(t["ids"])
        narrow = np.diff(off) == 2 * length  # a piece has one id at least
        parts = [data[a:b].view("<u2" if two else "<u4").astype("<u4") for a, b, two in zip(off, off[1:], narrow)]
        t["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<u4"), *parts]).view("<i4")))
        t["ids_crc32"] = pa.array(map(zlib.crc32, parts), pa.int64())
        t |= {"sequence_id": pa.array(runs[at, 2] + rank - runs[at, 1]), "offset": pa.array(runs[at, 3])}
        yield pa.RecordBatch.from_arrays(list(t.values()), list(t))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, end_id: int = 0, rows_a_bucket: int = 100_000, ids_a_bucket: int = 1 << 23) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, ids_crc32 (of ids as little-endian uint32), sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pieces(it, tokenizer, end_id, capacity), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = best_fit_runs(counts, capacity)
    plan = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    # Ranks within a length: buckets of a hash, each ordered on its own, behind the counts of those before.
    buckets = max(8, max(counts.values(), default=0) // rows_a_bucket, max((n * k for n, k in counts.items()), default=0) // ids_a_bucket)
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "salt"))
    ranked = keyed.withColumn("own", own).join(before, ["length", "bucket"])
    columns = ["doc_id", "piece", "start", "length", "ids"]
    ranked = ranked.select(*columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(lambda it: _placed(it, plan), PLACED)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all pieces, and checksums instead of their ids."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
