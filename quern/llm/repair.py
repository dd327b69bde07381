"""Token ids in grammar-compressed binary shards: Re-Pair with random access.

Each shard holds a run of documents in ascending doc_id order. Re-Pair replaces frequent pairs of ids by new
symbols (nonterminals), many pairs a round, the more frequent first, until no pair pays for its rule. A shard stores the rules, the
expansion length of each rule, the remaining sequence, and the documents' starts, so that one document is
decoded from the symbols that cover it alone.

A shard is little-endian: the magic b"QRP1"; uint32 symbol width (2 or 4 bytes), ids below which symbols are
terminals, documents, ids, rules, symbols; rule pairs (two symbols each); rule expansion lengths (uint32);
sequence; document starts (uint32, one more than documents). Shards travel in a binary column of Parquet files,
so that any store Spark knows can hold them.

Null and empty texts are the end id alone. Null ids come first; rows of one id are ordered by a hash of their texts, so
that reruns agree, and dealt by it, so that a crowd of them fills many tasks. An empty table writes no shard and reads back no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import new_path, small_batches, table
from quern.llm.token_counts import TOKENIZER
from quern.llm.tokens import encoder

MAGIC, HEAD = b"QRP1", struct.Struct("<4s6I")
SHARDS = "part int, shard int, n_docs long, n_ids long, doc_ids array<long>, payload binary"


def _apart(place: np.ndarray, often: np.ndarray, passes: int = 8) -> np.ndarray:
    """Which of the ascending places to take so that no two are neighbours: the pair seen more often wins, then the left one."""
    take, left = np.zeros(len(place), dtype=bool), np.arange(len(place))
    for _ in range(passes):
        if not len(left):
            return take
        at, n = place[left], often[left]
        near = np.diff(at) == 1
        beats_next = np.concatenate([~near | (n[:-1] >= n[1:]), [True]])
        beats_last = np.concatenate([[True], ~near | (n[1:] > n[:-1])])
        won = beats_next & beats_last
        take[left[won]] = True
        lost = np.concatenate([near & won[1:], [False]]) | np.concatenate([[False], near & won[:-1]])
        left = left[~won & ~lost]
    # Long runs of ties are left: every second of them, from the first.
    at = place[left]
    new_run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, dtype=bool)
    start = at[new_run][np.cumsum(new_run) - 1]
    take[left[(at - start) % 2 == 0]] = True
    return take


def _pruned(rules: np.ndarray, seq: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """The grammar without rules that nothing uses, or that one place of the sequence alone uses."""
    while len(rules):
        big, inner = seq[seq >= terminals], rules[rules >= terminals]
        in_seq, in_rules = (np.bincount(x.astype(np.int64) - terminals, minlength=len(rules)) for x in (big, inner))
        gone = (in_seq < 2) & (in_rules == 0)
        if not gone.any():
            break
        hit = np.zeros(len(seq), dtype=bool)
        hit[seq >= terminals] = gone[big.astype(np.int64) - terminals]
        first = np.arange(len(seq)) + np.cumsum(hit) - hit
        out = np.empty(len(seq) + int(hit.sum()), dtype=np.uint32)
        out[first[~hit]] = seq[~hit]
        pair = rules[seq[hit].astype(np.int64) - terminals]
        out[first[hit]], out[first[hit] + 1] = pair[:, 0], pair[:, 1]
        number = np.concatenate([np.arange(terminals), terminals + np.cumsum(~gone) - 1]).astype(np.uint32)
        rules, seq = number[rules[~gone]], number[out]
    return rules, seq


def compress(ids: np.ndarray, terminals: int = 1 << 16, least: int = 6, rounds: int = 48, min_gain: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, numbered from `terminals` on) and the sequence that expands to ids.

    A round replaces all pairs seen at least so often, where two overlap the one seen more often. The bound starts high
    and falls to a third when a round shortens the sequence by less than a share of `min_gain`, so that frequent pairs go
    first. The grammar is done when no pair is seen `least` times (a rule costs as much as it saves by four uses), or after
    `rounds`. Symbols stay within two bytes where terminals do: then the most frequent pairs get the numbers left.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    known, bound = 0, max(least, len(seq) >> 13)
    room = (1 << 16) - terminals if terminals < 1 << 16 else 1 << 31
    for _ in range(rounds):
        if len(seq) < 2 * least or known >= room:
            break
        pair = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        # Counts by a small hash bound the pairs' counts from above (in a core's cache): only promising places are sorted.
        mark = ((seq[:-1] * np.uint32(0x9E3779B1)) ^ (seq[1:] * np.uint32(0x85EBCA6B))) >> np.uint32(14)
        place = np.flatnonzero(np.bincount(mark, minlength=1 << 18)[mark] >= bound)
        which, found = pd.factorize(pair[place])
        count = np.bincount(which, minlength=len(found))
        good, before = count >= bound, len(seq)
        if good.any():
            hit = good[which]
            place, which = place[hit], which[hit]
            take = _apart(place, count[which])
            place, which = place[take], which[take]
            # Pairs that lost most of their places to others wait for a later round.
            won = np.bincount(which, minlength=len(found))
            kept = won >= max(least - 1, bound // 2)
            if kept.sum() > room - known:
                order = np.argsort(-np.where(kept, won, 0), kind="stable")[: room - known]
                kept = np.zeros(len(found), dtype=bool)
                kept[order] = True
            here = kept[which]
            place, which = place[here], (np.cumsum(kept) - 1)[which[here]]
            seq = seq.copy()
            seq[place] = terminals + known + which
            keep = np.ones(len(seq), dtype=bool)
            keep[place + 1] = False
            seq = seq[keep]
            chosen = found[kept]
            rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
            known += len(chosen)
        if before - len(seq) < min_gain * before:
            if bound == least:
                break
            bound = max(least, bound // 3)
    return _pruned(np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq, terminals)


def lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Number of ids that each rule expands to; a rule uses earlier ones only."""
    n = np.ones(len(rules), dtype=np.int64)
    done = np.zeros(len(rules), dtype=bool)
    while not done.all():
        a, b = (rules[:, i].astype(np.int64) - terminals for i in (0, 1))
        ready = ~done & ((a < 0) | done[np.maximum(a, 0)]) & ((b < 0) | done[np.maximum(b, 0)])
        n[ready] = sum(np.where(x[ready] < 0, 1, n[np.maximum(x[ready], 0)]) for x in (a, b))
        done |= ready
    return n


def expand(seq: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    while True:
        big = seq >= terminals
        if not big.any():
            return seq
        count = big.astype(np.int64) + 1
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.uint32)
        out[first[~big]] = seq[~big]
        pair = rules[seq[big].astype(np.int64) - terminals]
        out[first[big]], out[first[big] + 1] = pair[:, 0], pair[:, 1]
        seq = out


def pack_shard(ids: np.ndarray, starts: np.ndarray) -> bytes:
    terminals = int(ids.max()) + 1 if len(ids) else 1
    rules, seq = compress(ids, terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = HEAD.pack(MAGIC, width, terminals, len(starts) - 1, len(ids), len(rules), len(seq))
    return b"".join([head, rules.astype(kind).tobytes(), lengths(rules, terminals).astype("<u4").tobytes(), seq.astype(kind).tobytes(), starts.astype("<u4").tobytes()])


class Shard:
    """A shard for reading: all ids at once, or one document's."""

    def __init__(self, payload: bytes):
        magic, width, self.terminals, self.n_docs, self.n_ids, n_rules, n_seq = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a shard of grammar-compressed ids")
        at = HEAD.size
        parts = []
        for kind, n in ((f"<u{width}", 2 * n_rules), ("<u4", n_rules), (f"<u{width}", n_seq), ("<u4", self.n_docs + 1)):
            parts.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
            at += n * int(kind[-1])
        self.rules, self.rule_length, self.seq, self.starts = parts[0].astype(np.uint32).reshape(-1, 2), parts[1], parts[2].astype(np.uint32), parts[3]

    def ids(self) -> np.ndarray:
        return expand(self.seq, self.rules, self.terminals)

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, from the symbols that cover it."""
        if not hasattr(self, "ends"):
            n = np.ones(len(self.seq), dtype=np.int64)
            big = self.seq >= self.terminals
            n[big] = self.rule_length[self.seq[big].astype(np.int64) - self.terminals]
            self.ends = np.cumsum(n)
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        lo, hi = int(np.searchsorted(self.ends, a, side="right")), int(np.searchsorted(self.ends, b, side="left")) + 1
        skip = a - (int(self.ends[lo - 1]) if lo else 0)
        return expand(self.seq[lo:hi], self.rules, self.terminals)[skip : skip + b - a]


def _write(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, shard_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    own, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
    docs: list = []
    held: list[np.ndarray] = []
    size = 0

    def full() -> pa.RecordBatch:
        nonlocal docs, held, size, shard
        starts = np.cumsum([0, *map(len, held)])
        payload = pack_shard(np.concatenate(held), starts)
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([int(starts[-1])], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["part", "shard", "n_docs", "n_ids", "doc_ids", "payload"])
        docs, held, size, shard = [], [], 0, shard + 1
        return out

    for batch in batches:
        ids, row = batch.column("doc_id").to_pylist(), 0
        for flat, begin in own.ids(batch.column("text")):
            for i in range(len(begin) - 1):
                doc = np.empty(begin[i + 1] - begin[i] + 1, dtype=np.uint32)
                doc[:-1], doc[-1] = flat[begin[i] : begin[i + 1]], end_id
                docs.append(ids[row + i])
                held.append(doc)
                size += len(doc)
                if size >= shard_ids:
                    yield full()
            row += len(begin) - 1
    if held:
        yield full()


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0, shard_ids: int = 1 << 20) -> None:
    """Write the ids of docs to path, in ascending doc_id order over (part, shard).

    Texts are dealt by ranges of doc_id before they are encoded, so each is encoded once.
    """
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(lambda it: _write(it, tokenizer, end_id, shard_ids), SHARDS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["payload"])
            ids, starts = shard.ids().astype("<u4", copy=False), shard.starts.astype(np.int64)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts[:-1] + r["before"]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of the shards at path: doc_id, start, n_tokens, ids_crc32 of the decoded ids."""
    small_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per part of the writing job
    before_part = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before_part"))
    inner = shards.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("inner"))
    before = inner.join(before_part, "part").select("part", "shard", (F.col("inner") + F.col("before_part")).alias("before"))
    return shards.join(before, ["part", "shard"]).select("doc_ids", "payload", "before").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
