"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles. Texts with equal sets (by size and a digest of 128 bits)
   form a class, and only its least id goes on, so a group of exact copies costs as much as one text.
2. Minima of `bands * rows` hash functions. A band's minima are one key; texts that share a key of any band are
   candidates. At the least similarity of 0.8, 44 bands of 6 rows miss a pair with probability
   (1 - 0.8**6) ** 44 = 1.6e-6.
3. Within a bucket (a key), texts are compared with one hub, its least id: first by the low bits of their
   minima, packed, whose equal share is corrected for chance collisions (1 / 2**bits), then, unless the estimate is
   below the least similarity by `slack` standard errors, on the full sets. A hub of many texts is salted.
4. Components of the confirmed links. Buckets whose texts all fell in one component are done: a large group of near
   copies takes comparisons in proportion to its size. In the others, texts of different components are compared in
   blocks: first the packed bits alone, dealt without texts, then, for the texts that have a likely partner in their
   block, the full sets; a block sends a spanning forest of the links that it finds, not pairs. So no link between
   components is lost, and a passage that many unlike documents share costs comparisons of some bytes.

Texts without words link with nothing. Null texts count as empty. A document is an id: rows of one id are one document,
which links with whatever one of its texts links with, and whose set size is that of its largest set. Rows without an
id are returned as they are, each for itself. Empty tables give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.shared import Scratch, runs, small_batches, spread, stored, table
from quern.llm.textvec import Words, mix

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, bits binary"


@dataclass(frozen=True)
class Settings:
    width: int = 5
    #: A link has 100 * common >= percent * union.
    percent: int = 80
    bands: int = 44
    rows: int = 6
    bits: int = 2
    slack: float = 5.0
    seed: int = 5

    def estimate_floor(self) -> float:
        """The least share of equal low bits that a candidate may show."""
        s, chance, k = self.percent / 100, 2.0**-self.bits, self.bands * self.rows
        p = s + (1 - s) * chance
        return p - self.slack * (p * (1 - p) / k) ** 0.5


def _minima(h: np.ndarray, first: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Minima (rows x k, uint32) of k hash functions over each row's shingles; rows without any stay at the top."""
    rng = np.random.default_rng(seed)
    factor, shift = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)
    out = np.full((len(first) - 1, k), 0xFFFFFFFF, dtype=np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32) ^ (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    begin = first[full]
    i = 0
    while i < len(full):  # blocks that fit in a core's cache
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + 32_768, side="left")))
        a, b = int(begin[i]), int(first[full[j - 1] + 1])
        own, starts, rows = low[a:b], begin[i:j] - a, full[i:j]
        for f in range(k):
            x = (own ^ shift[f]) * factor[f]
            x ^= x >> np.uint32(15)
            out[rows, f] = np.minimum.reduceat(x, starts)
        i = j
    return out


def _parts(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    size = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _sketches(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    k = s.bands * s.rows
    for batch in batches:
        at = 0
        for texts in _parts(batch.column("text")):
            h, first = Words(texts).shingles(s.width)
            n = np.diff(first)
            minima = _minima(h, first, k, s.seed)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                d1, d2 = ((x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums)
                keys = np.zeros((len(n), s.bands), dtype=np.uint64)
                for r in range(s.rows):
                    keys = mix(keys * np.uint64(0x100000001B3) + minima[:, r :: s.rows].astype(np.uint64))
                keys = mix(keys + np.arange(s.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            shifts = np.arange(s.bits, dtype=np.uint32)
            packed = np.packbits(((minima[:, :, None] >> shifts) & 1).astype(np.uint8).reshape(len(n), -1), axis=1)
            width = packed.shape[1]
            some = n > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * s.bands)]).astype(np.int32)), pa.array(keys[some].view(np.int64).reshape(-1)))
            bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * width).astype(np.int32)), pa.py_buffer(packed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(n)), pa.array(n), pa.array(d1), pa.array(d2), lists, bits], ["doc_id", "n_shingles", "d1", "d2", "bands", "bits"])
            at += len(n)


def _estimated(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, a_bits, b_bits), those that the estimate does not rule out."""
    floor, k = s.estimate_floor(), s.bands * s.rows
    for batch in batches:
        if not len(batch):
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for c in ("a_bits", "b_bits"))
        differ = np.unpackbits(x ^ y, axis=1)[:, : k * s.bits].reshape(len(batch), k, s.bits).any(axis=2)
        keep = pa.array(1 - differ.mean(axis=1) >= floor)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, a_text, b_text), those whose full sets are similar enough. Rows of one a come together, mostly."""
    last: tuple = (None, None, None)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep, at = np.zeros(len(a), dtype=bool), 0
        for texts in _parts(batch.column("b_text")):
            h, first = Words(texts).shingles(s.width)
            for i in range(len(texts)):
                own = batch.column("a_text")[at + i]
                if last[0] != a[at + i] or not own.equals(last[1]):
                    last = (a[at + i], own, Words(batch.column("a_text").slice(at + i, 1)).shingles(s.width)[0])
                mine, other = last[2], h[first[i] : first[i + 1]]
                found = np.searchsorted(mine, other)
                common = int((mine[np.minimum(found, len(mine) - 1)] == other).sum()) if len(mine) else 0
                keep[at + i] = 100 * common >= s.percent * (len(mine) + len(other) - common) and common > 0
            at += len(texts)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _salted(pairs: DataFrame, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """pairs with a salt, and the rows (a, salt) of their hubs: no salt of a hub has much more than `most` pairs."""
    salts = F.coalesce("salts", F.lit(1))
    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("salts"))
    dealt = pairs.join(hubs.where("salts > 1"), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("salts")
    return dealt, hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))


def _with(pairs: DataFrame, hubs: DataFrame, facts: DataFrame, what: str) -> DataFrame:
    """pairs (a, b, salt) with a column of facts (doc_id) for both ends; the salts keep a hub out of one task."""
    own = hubs.join(facts.select(F.col("doc_id").alias("a"), F.col(what).alias(f"a_{what}")), "a")
    return pairs.join(facts.select(F.col("doc_id").alias("b"), F.col(what).alias(f"b_{what}")), "b").join(own, ["a", "salt"])


def _texts_of(ids: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """The different texts of the ids (doc_id): rows that repeat are one."""
    # Written first, so that Spark knows the ids' size before it plans: few ids go to the texts, not the texts to them.
    wanted = scratch.stored(ids.distinct(), "wanted")
    return texts.join(wanted, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text")).select("doc_id", "text")


def _links(pairs: DataFrame, leaders: DataFrame, texts: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """The pairs (a < b) that are links: by estimate, then on full sets."""
    pairs, hubs = _salted(pairs)
    likely = _with(pairs, hubs, leaders, "bits").select("a", "b", "a_bits", "b_bits").mapInArrow(lambda it: _estimated(it, s), "a long, b long")
    likely = scratch.stored(likely.distinct(), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id"))
    likely, hubs = _salted(likely)
    full = _with(likely, hubs, scratch.stored(_texts_of(wanted, texts, scratch), "texts"), "text").select("a", "b", "a_text", "b_text")
    return scratch.stored(full.mapInArrow(lambda it: _confirmed(it, s), "a long, b long").distinct(), "links")


def _block_links(ids: np.ndarray, comp: np.ndarray, part: np.ndarray, bits: np.ndarray, texts: pa.Array, s: Settings) -> Iterator[tuple[int, int]]:
    """Links between components among a block's documents: a forest of them, not all pairs.

    part: 0 or 1; in a block of two parts only pairs across them are compared.
    """
    k, floor, two = s.bands * s.rows, s.estimate_floor(), part.min() != part.max()
    low = np.unpackbits(bits, axis=1)[:, : k * s.bits].reshape(len(ids), k, s.bits)
    low = (low << np.arange(s.bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    h, first = Words(texts).shingles(s.width)
    size = np.diff(first)
    root = {int(c): int(c) for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        own = np.array([find(int(c)) for c in np.unique(comp[j])])
        label = own[np.searchsorted(np.unique(comp[j]), comp[j])]
        fits = (label != find(int(comp[i]))) & (100 * np.minimum(size[j], size[i]) >= s.percent * np.maximum(size[j], size[i]))
        if two:
            fits &= part[j] != part[i]
        j = j[fits]
        if len(j):
            j = j[(low[j] == low[i]).mean(axis=1) >= floor]
        if not len(j):
            continue
        mine = h[first[i] : first[i + 1]]
        at = np.concatenate([np.arange(first[x], first[x + 1]) for x in j])
        hit = mine[np.minimum(np.searchsorted(mine, h[at]), len(mine) - 1)] == h[at]
        common = np.add.reduceat(hit, np.cumsum(size[j]) - size[j])
        for x in j[100 * common >= s.percent * (size[i] + size[j] - common)]:
            a, b = find(int(comp[i])), find(int(comp[x]))
            if a != b:
                root[max(a, b)] = min(a, b)
                yield int(min(ids[i], ids[x])), int(max(ids[i], ids[x]))


def _screened(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, doc_id, comp, n, bits) in the order of block: those with a likely partner in another component."""
    k, floor = s.bands * s.rows, s.estimate_floor()
    most = int((1 - floor) * k)
    pairs = np.uint64(int("01" * 32, 2)) if s.bits == 2 else None
    for t in runs(batches, "block"):
        size, comp, part = (t[c].to_numpy() for c in ("n", "comp", "part"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), dtype=np.uint8).reshape(len(t), -1)
        if pairs is None:  # one byte for each hash
            low = np.unpackbits(bits, axis=1)[:, : k * s.bits].reshape(len(t), k, s.bits)
            low = (low << np.arange(s.bits, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        else:
            low = np.zeros((len(t), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
            low[:, : bits.shape[1]] = bits
            low = low.view(np.uint64)
        seen, two = np.zeros(len(t), dtype=bool), part.min() != part.max()
        for i in range(len(t) - 1):
            fits = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= s.percent * np.maximum(size[i + 1 :], size[i]))
            if two:
                fits &= part[i + 1 :] != part[i]
            j = np.flatnonzero(fits) + i + 1
            if len(j):
                x = low[j] ^ low[i]
                differ = (x != 0).sum(axis=1) if pairs is None else np.bitwise_count((x | (x >> np.uint64(1))) & pairs).sum(axis=1)
                j = j[differ <= most]
                seen[j] = True
                seen[i] |= len(j) > 0
        if seen.any():
            yield from t.select(["block", "part", "doc_id", "comp"]).filter(pa.array(seen)).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, doc_id, comp, bits, text) in the order of block: the links of each block."""
    for t in runs(batches, "block"):
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), dtype=np.uint8).reshape(len(t), -1)
        found = list(_block_links(t["doc_id"].to_numpy(), t["comp"].to_numpy(), t["part"].to_numpy(), bits, t["text"].combine_chunks(), s))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])


def _dealt(members: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """members (key, doc_id and others) with a block and a part: keys of up to `block` documents are one block each.

    Larger ones are dealt to parts by a hash, and each pair of parts is a block of its own, so that no task gets a whole
    large key.
    """
    large = scratch.stored(members.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts")).where("parts > 1"), "large")
    parts = F.coalesce("parts", F.lit(1))
    dealt = members.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.withColumns({"block": pair, "part": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other", "parts")


def _across(members: DataFrame, leaders: DataFrame, texts: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """Links between components within buckets: members has key, doc_id and comp."""
    facts = leaders.select("doc_id", F.col("n_shingles").alias("n"), "bits")
    rows = _dealt(members, 2048, scratch).join(facts, "doc_id").select("block", "part", "doc_id", "comp", "n", "bits")
    likely = spread(rows, "block").sortWithinPartitions("block").mapInArrow(lambda it: _screened(it, s), "block long, part int, doc_id long, comp long")
    likely = scratch.stored(likely, "screened")
    # Few are left in a block, as a rule; where many are, they are dealt again, to blocks whose texts fit in memory.
    again = _dealt(likely.select(F.struct("block", "part").alias("from"), F.col("block").alias("key"), "doc_id", "comp"), 512, scratch).drop("from")
    own = scratch.stored(_texts_of(likely.select("doc_id"), texts, scratch), "texts").join(leaders.select("doc_id", "bits"), "doc_id")
    rows = spread(again.join(own, "doc_id").select("block", "part", "doc_id", "comp", "bits", "text"), "block").sortWithinPartitions("block", "doc_id")
    return scratch.stored(rows.mapInArrow(lambda it: _blocks(it, s), "a long, b long"), "across")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable over links) of each document."""
    s = settings
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with Scratch(docs.sparkSession) as scratch:
        sketches = scratch.stored(texts.mapInArrow(lambda it: _sketches(it, s), SKETCH), "sketches", keep=True)
        full = sketches.where("n_shingles > 0 and doc_id is not null")
        # One row of each set: partial aggregation meets large groups of copies before the shuffle.
        leaders = scratch.stored(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "leaders", keep=True)
        reps = full.select("doc_id", "n_shingles", "d1", "d2").join(leaders.select("n_shingles", "d1", "d2", F.col("doc_id").alias("rep")), ["n_shingles", "d1", "d2"])
        reps = scratch.stored(reps.select("doc_id", "rep"), "reps", keep=True)
        # A document of several texts ties their sets together.
        several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("doc_id", "a")
        ties = scratch.stored(reps.join(several, "doc_id").where("a < rep").select("a", F.col("rep").alias("b")).distinct(), "ties")
        bands = leaders.select("doc_id", F.explode("bands").alias("key"))
        buckets = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub")
        crowded = scratch.stored(bands.join(buckets, "key").select("key", "hub", "doc_id"), "crowded")
        stars = crowded.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
        links = _links(stars, leaders, texts, s, scratch).unionByName(ties)
        labels = components(links, scratch)
        # Buckets whose documents are in several components: those are compared across components.
        known = crowded.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        known = scratch.stored(known, "known")
        open_ = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high and n > 2").select("key")
        members = scratch.stored(known.join(scratch.stored(open_, "open"), "key").select("key", "doc_id", "comp").distinct(), "members")
        more = _across(members, leaders, texts, s, scratch)
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)
    # A document's component: that of its sets, by way of their least ids.
    comp = reps.join(labels, reps["rep"] == labels["id"], "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    n = sketches.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    ids = n.join(comp, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return ids.unionByName(sketches.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose document has the least id of its component, and those without an id.

    Rows of one id and equal texts are copies, of which the one with the least hash of its columns stays. Different texts
    of a kept id all stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = near_duplicates(docs.select("doc_id", "text"), settings)
    gone = found.where("doc_id != component_id").select("doc_id", F.lit(1).alias("why"))
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(0).alias("why"))
    # Documents that go and ids that repeat are few, as a rule: all other rows need no shuffle where those can be sent to them.
    flags = stored(gone.unionByName(again).groupBy(F.col("doc_id").alias("_one_id")).agg(F.max("why").alias("_one_why")), "flags")
    rows = docs.where("doc_id is not null").select(F.struct(*columns).alias("_row"))
    marked = rows.join(flags, F.col("_row.doc_id") == F.col("_one_id"), "left").where("_one_why is null or _one_why = 0")
    copies = marked.where("_one_why = 0").groupBy("_one_id", F.xxhash64("_row.text").alias("_hash")).agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return marked.where("_one_why is null").select("_row.*").unionByName(copies.select("_row.*")).unionByName(docs.where("doc_id is null"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Settings(width=4))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
