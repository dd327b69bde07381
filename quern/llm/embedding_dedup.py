"""Embedding near-duplicates by collision-counting projections, confirmed by cosine in double precision.

Unit vectors are projected on many random unit directions. For a link of cosine c the projections differ by
about sqrt(2 - 2c) / sqrt(dim) on each, so a window of about one such deviation around a query holds a true
partner on most projections, and other vectors on few.

1. Equal vectors (after normalising) form a class with a count; one of each goes on.
2. Windows on one direction hold a constant share of all vectors, so counting alone compares all pairs. Tables of
   cells deal the work: a table's cell is the signs of `signs` further projections, more where there are more vectors.
   A pair is counted in the first table whose cell it shares, and there are as many tables as it takes that a pair at the
   least cosine shares none with probability `miss`. A row of a table holds projections in steps of a byte, not vectors.
   Crowded cells are cut into blocks of parts against parts, so that no task gets a cell's square.
3. In a block, vectors are sorted on each of the `count` projections. A query's window there is a range of ranks,
   and collisions are counted per pair. The least count is calibrated from the binomial law of collisions, whose chance
   per projection is measured on seeded pairs of exactly the least cosine, so that such a pair falls short with
   probability `miss`.
4. Whole vectors go to the blocks where they have a pair with enough collisions, and pairs are confirmed there by cosine. A
   block sends each vector's number of partners and, for components, a spanning forest of its links, not the pairs. Both
   ends of a pair are counted at once, so links are symmetric.

Null and zero vectors, and those with null or non-finite components, link with nothing. Vectors of different
dimension don't link. Ties and repeated rows are members of one class: each links with the others. Rows without an
id count as members and are returned without a component. Empty tables give no rows. Labels aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import Scratch, runs, small_batches, spread, table


@lru_cache(16)
def directions(dim: int, n: int, seed: int) -> np.ndarray:
    d = np.random.default_rng([seed, dim]).standard_normal((n, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


#: Steps of a window's half width, of which a byte holds 127 on either side.
STEPS = 8


@dataclass(frozen=True)
class Plan:
    """What a run counts by: the same on all tasks."""

    cosine: float
    count: int
    signs: int
    miss: float
    seed: int

    def tables(self) -> int:
        """Tables until a pair at the least cosine shares a cell with probability 1 - miss."""
        share = (1 - acos(max(-1.0, min(1.0, self.cosine))) / pi) ** self.signs
        return 1 if share >= 1 or not self.signs else ceil(log(self.miss) / log(1 - share))

    @lru_cache(16)  # noqa: B019
    def calibrate(self, dim: int, pairs: int = 4000) -> tuple[float, int]:
        """Half width of the windows and the least count, from seeded pairs of unit vectors at exactly the least cosine."""
        rng = np.random.default_rng([self.seed, dim, 1])
        a, b = rng.standard_normal((2, pairs, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        norm = np.linalg.norm(b, axis=1, keepdims=True)
        b = self.cosine * a + max(0.0, 1 - self.cosine**2) ** 0.5 * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
        p, q = (x @ directions(dim, 16, self.seed).T for x in (a, b))
        half = max(float(np.quantile(np.abs(p - q), 0.75)), 1e-9)
        hit = float((np.abs(steps(p, half) - steps(q, half)) <= STEPS).mean())
        tail, least = 0.0, 0
        for k in range(self.count + 1):
            tail += comb(self.count, k) * hit**k * (1 - hit) ** (self.count - k)
            if tail > self.miss:
                least = k
                break
        return half, least

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector (rows) in each table (columns)."""
        n = self.tables()
        up = x @ directions(x.shape[1], n * self.signs, self.seed + 1).T >= 0
        return (up.reshape(len(x), n, self.signs) * (1 << np.arange(self.signs, dtype=np.int64))).sum(axis=2)


def steps(p: np.ndarray, half: float) -> np.ndarray:
    """Projections in steps of an eighth of the windows' half width; the few beyond the range of a byte stop there."""
    return np.clip(np.rint(p * (STEPS / half)), -127, 127).astype(np.int16)


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (double) of each dimension in a list column without nulls."""
    width, values = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(width)])
    for dim in np.unique(width):
        rows = np.flatnonzero(width == dim)
        yield rows, values[first[rows][:, None] + np.arange(dim)]


def _dealt(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """For each vector (rep, unit) and table a row: cell, rep, q (its projections, bytes) and codes (its cells)."""
    for batch in batches:
        for rows, x in _units(batch.column("unit")):
            half, _ = plan.calibrate(x.shape[1])
            q = steps(x @ directions(x.shape[1], plan.count, plan.seed).T, half).astype(np.int8)
            cells = plan.cells(x)
            rep = batch.column("rep").take(pa.array(rows))
            blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (q, cells.astype("<u4"))]
            for t in range(cells.shape[1]):
                cell = pa.array((x.shape[1] << 44) + (t << 32) + cells[:, t])
                yield pa.RecordBatch.from_arrays([cell, rep, *blobs], ["cell", "rep", "q", "codes"])


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _candidates(q: np.ndarray, codes: np.ndarray, part: np.ndarray, table_: int, least: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of a block with enough collisions, which share no earlier table. Two parts: only pairs across them."""
    n, count = q.shape
    order = np.argsort(q, axis=0, kind="stable")
    ranked = np.take_along_axis(q, order, axis=0)
    rank = np.empty((n, count), dtype=np.uint16)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.uint16)[:, None], axis=0)
    rank = np.ascontiguousarray(rank.T)
    # Unsigned ranks: rank - first wraps below the window, so one comparison tells whether it lies within.
    first = np.stack([np.searchsorted(ranked[:, j], q[:, j] - STEPS, side="left") for j in range(count)]).astype(np.uint16)
    width = np.stack([np.searchsorted(ranked[:, j], q[:, j] + STEPS, side="right") for j in range(count)]).astype(np.uint16) - first
    two = part.min() != part.max()
    for lo in range(0, n - 1, rows):
        hi = min(n, lo + rows)
        hits = np.zeros((hi - lo, n - lo), dtype=np.uint8)
        for c in range(count):
            hits += (rank[c, None, lo:] - first[c, lo:hi, None] < width[c, lo:hi, None]).view(np.uint8)
        i, j = np.nonzero(hits >= least)
        i, j = i + lo, j + lo
        keep = i < j
        if two:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        if table_ and len(i):
            fresh = np.concatenate([(codes[i[s : s + 65536], :table_] != codes[j[s : s + 65536], :table_]).all(axis=1) for s in range(0, len(i), 65536)])
            i, j = i[fresh], j[fresh]
        if len(i):
            yield i, j


def _screened(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, cell, rep, q, codes) in the order of block: those that have a candidate in their block."""
    for t in runs(batches, "block"):
        if len(t) < 2:
            continue
        cell = int(t["cell"][0].as_py())
        _, least = plan.calibrate(cell >> 44)
        seen = np.zeros(len(t), dtype=bool)
        for i, j in _candidates(_matrix(t["q"], "i1").astype(np.int16), _matrix(t["codes"], "<u4"), t["part"].to_numpy(), cell >> 32 & 0xFFF, least):
            seen[i] = seen[j] = True
        if seen.any():
            yield from t.select(["block", "part", "cell", "rep"]).filter(pa.array(seen)).combine_chunks().to_batches()


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b), as links of each id to the least of its component here."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return ids[label], ids
        label = new


def _linked(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, cell, rep, n, unit) in the order of block: (a, null, n) for n partners of a, (a, b, 0) for links of a forest."""
    for t in runs(batches, "block"):
        cell, rep, n = int(t["cell"][0].as_py()), t["rep"].to_numpy(), t["n"].to_numpy()
        unit = t["unit"].chunk(0) if len(t) else None
        ((_, x),) = _units(unit)
        half, least = plan.calibrate(x.shape[1])
        q = steps(x @ directions(x.shape[1], plan.count, plan.seed).T, half)
        partners, a, b = np.zeros(len(rep), np.int64), [], []
        for i, j in _candidates(q, plan.cells(x), t["part"].to_numpy(), cell >> 32 & 0xFFF, least):
            cos = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], x[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
            i, j = i[cos >= plan.cosine], j[cos >= plan.cosine]
            np.add.at(partners, i, n[j])
            np.add.at(partners, j, n[i])
            a.append(rep[i])
            b.append(rep[j])
        some = partners > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(partners[some])], ["a", "b", "n"])
            root, ids = _forest(np.concatenate(a), np.concatenate(b))
            far = root != ids
            yield pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(ids[far]), pa.array(np.zeros(int(far.sum()), np.int64))], ["a", "b", "n"])


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, count: int = 48, signs: int = 8, cell_rows: int = 256, miss: float = 5e-6, seed: int = 3, block: int = 512) -> DataFrame:
    """vec_id, n_links and component_id of each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # Scaling by the largest component first keeps the squares within range.
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    rows = rows.withColumn("top", F.when(F.coalesce(finite, F.lit(False)), top)).withColumn("x", F.when(F.col("top") > 0, F.transform("x", lambda v: v / F.col("top"))))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    rows = rows.withColumn("norm", norm).select("vec_id", F.when(F.col("norm") > 0, F.transform("x", lambda v: v / F.col("norm") + F.lit(0.0))).alias("unit"))
    rows = rows.withColumn("key", F.sha2(F.array_join(F.transform("unit", lambda v: v.cast("string")), ","), 256))
    with Scratch(spark) as scratch:
        rows = scratch.stored(rows, "vectors", keep=True)
        classes = scratch.stored(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit")).where("rep is not null"), "classes", keep=True)
        n = classes.count()
        plan = Plan(cosine, count, max(signs, ceil(log2(max(n, 1) / cell_rows))), miss, seed)
        cells = spread(classes.select("rep", "unit"), "rep").mapInArrow(lambda it: _dealt(it, plan), "cell long, rep long, q binary, codes binary")
        # Crowded cells are dealt to parts; each pair of parts is a block of its own.
        crowded = cells.groupBy("cell").count().where(F.col("count") > block).select("cell", F.ceil(F.col("count") / F.lit(block)).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        placed = cells.join(crowded, "cell", "left").withColumn("own", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        place = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("block")
        placed = placed.select(place, (F.col("own") > F.col("other")).cast("int").alias("part"), "cell", "rep", "q", "codes")
        screened = scratch.stored(spread(placed, "block").sortWithinPartitions("block").mapInArrow(lambda it: _screened(it, plan), "block long, part int, cell long, rep long"), "screened")
        full = spread(screened.join(classes.select("rep", "n", "unit"), "rep").select("block", "part", "cell", "rep", "n", "unit"), "block").sortWithinPartitions("block")
        found = scratch.stored(full.mapInArrow(lambda it: _linked(it, plan), "a long, b long, n long"), "found", keep=True)
        labels = components(found.where("b is not null").select("a", "b"), scratch)
    partners = found.where("b is null").groupBy("a").agg(F.sum("n").alias("linked"))
    facts = classes.select("key", "rep", "n").join(partners, F.col("rep") == F.col("a"), "left").drop("a").join(labels, F.col("rep") == F.col("id"), "left")
    facts = facts.select("key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("vec_id", "key").join(facts, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("comp", "vec_id")).alias("component_id"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
