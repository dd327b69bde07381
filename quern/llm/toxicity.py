"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document's features are the
distinct hashes of its words, pairs of neighbours and pairs with one word between. Follow-the-regularised-
leader gives every coordinate its own rate, and its L1 term leaves few weights that are not 0, so the model
is a short list that travels in the tasks' closure (at most 2 ** bits weights, checked).

Learning reads a bounded sample: the `most_docs` labelled rows with the smallest seeded hash. Repeated labels
of a document count as toxic if one says so, any label above 0 does; null labels are ignored. Without labelled rows the score is 0.5.
Null and empty texts have no features and score by the bias alone. Repeated rows are scored each. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import id_fold, one_label, seeded_sample, small_batches, table
from quern.llm.textvec import NOT_ALNUM, Words

BITS, MOST_DOCS, SEED = 20, 10_000, 11
#: Word offsets and salts of words, pairs and skip-pairs.
GRAMS = (((0,), 1), ((0, 1), 2), ((0, 2), 3))


def _features(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words = Words(texts, NOT_ALNUM)
    for offsets, salt in GRAMS:
        h, row = words.grams(offsets, salt)
        yield (h >> np.uint64(64 - bits)).astype(np.int64), row


def _distinct(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct features of each row."""
    found = list(_features(texts, bits))
    code = np.unique(np.concatenate([(r << bits) | h for h, r in found]))
    return np.split(code & ((1 << bits) - 1), np.searchsorted(code >> bits, np.arange(1, len(texts))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = 4, alpha: float = 3.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that are not 0, and the bias."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = bias = 0.0
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[k]
            if abs(g) < 1e-6:
                continue
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    found = np.flatnonzero(np.abs(z) > l1)
    return found, weights(found), float(bias)


def _train(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        if len(batch):
            rows += _distinct(batch.column("text"), bits)
            labels += [x > 0 for x in batch.column("label").to_pylist()]
    if not rows:
        return
    at, w, bias = fit(rows, np.array(labels, dtype=float), bits)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w, bias))], ["at", "w"])


def train(docs: DataFrame, labelled: DataFrame, bits: int = BITS, most_docs: int = MOST_DOCS) -> dict[int, float]:
    """Weights by coordinate, the bias at -1; labelled has doc_id and label (0 or 1), a row per document."""
    small_batches(docs.sparkSession)
    sample = seeded_sample(labelled, most_docs, SEED)
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", "label")
    # One bounded task learns; the order is fixed, so that reruns agree.
    found = rows.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(lambda it: _train(it, bits), "at long, w double").collect()
    assert len(found) <= (1 << bits) + 1
    return {r["at"]: r["w"] for r in found}


def _scores(batches: Iterator[pa.RecordBatch], at: np.ndarray, w: np.ndarray, bias: float, bits: int) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << bits)
    table[at] = w
    for batch in batches:
        margin = np.full(len(batch), bias)
        texts, lo = batch.column("text"), 0
        size = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < len(batch):  # parts of some MB bound the arrays
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 22), side="right")))
            part, codes = texts.slice(lo, hi - lo), []
            for h, row in _features(part, bits):
                own = table[h] != 0
                codes.append((row[own] << bits) | h[own])
            code = np.unique(np.concatenate(codes))
            margin[lo:hi] += np.bincount(code >> bits, weights=table[code & ((1 << bits) - 1)], minlength=hi - lo)
            lo = hi
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))], [*batch.schema.names, "score"])


def toxicity_scores(docs: DataFrame, model: dict[int, float], bits: int = BITS) -> DataFrame:
    """doc_id, text and score (0 to 1) of each row of docs."""
    small_batches(docs.sparkSession)
    at = np.array(sorted(k for k in model if k >= 0), dtype=np.int64)
    w, bias = np.array([model[k] for k in at.tolist()]), model.get(-1, 0.0)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, at, w, bias, bits), "doc_id long, text string, score double")


def learn(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """The model from the labels outside the held-out fold: crc32(doc_id as text) mod 3 is not 1."""
    return train(docs, one_label(labels, "toxic", F.max).where(id_fold("doc_id", 3) != 1))


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.7) -> DataFrame:
    """The rows of docs that score below reject, with their columns."""
    small_batches(docs.sparkSession)
    model = learn(docs, labels)
    at = np.array(sorted(k for k in model if k >= 0), dtype=np.int64)
    w, bias, bits = np.array([model[k] for k in at.tolist()]), model.get(-1, 0.0), BITS

    def kept(batches):
        for batch in batches:
            for scored in _scores(iter([batch]), at, w, bias, bits):
                yield batch.filter(pc.less(scored.column(scored.num_columns - 1), reject))

    return docs.mapInArrow(kept, docs.schema)


def op10_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
