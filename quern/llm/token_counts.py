"""Token counts of whole texts; huge documents by overlapping chunks that are resynchronised.

A huge document is encoded in chunks that start at fixed places and overlap. Two neighbours are spliced at a
place that is a pre-token boundary in both. The pre-token scanner keeps no state between pieces, so from a
common boundary on both chunks cut the same way, and merges never cross a piece: the splice equals the
encoding of the whole. Boundaries near a chunk's cut end are not used, since the missing text could move them.
Where the overlap has no common boundary, it is doubled, up to the end of the document.

Null texts count as empty (0 tokens); empty texts give 0; repeated rows give a row each; other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quern.llm.shared import small_batches, table
from quern.llm.tokens import PieceEncoder, encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"


class _Chunk:
    """A chunk's ids, and the places (in the document) and ids before each pre-token boundary in it."""

    def __init__(self, library, text: str, start: int, end: int):
        e = library.encode(text[start:end], add_special_tokens=False)
        self.ids = np.array(e.ids, dtype=np.uint32)
        word = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        self.before = first
        offsets = e.offsets  # the library builds the list anew at each access
        self.place = np.array([offsets[i][0] for i in first], dtype=np.int64) + start
        self.end = end

    def at(self, place: int) -> int:
        return int(self.before[np.searchsorted(self.place, place)])


def resynchronised(library, text: str, chunk: int, overlap: int, margin: int = 32) -> Iterator[np.ndarray]:
    """The ids of text, in runs, from overlapping chunks."""
    n = len(text)
    left, splice, following = None, 0, chunk
    while True:
        wide = overlap
        if left is None:
            left = _Chunk(library, text, splice, min(n, following + wide))
        while left.end < n:
            right = _Chunk(library, text, following, min(n, following + max(chunk, wide) + wide))
            sure = min(left.end, right.end if right.end < n else left.end) - margin
            common = np.intersect1d(left.place[(left.place >= following) & (left.place <= sure)], right.place)
            if len(common):
                break
            wide *= 2
            left = _Chunk(library, text, splice, min(n, following + wide))
        if left.end >= n:
            yield left.ids[left.at(splice) :] if len(left.ids) else left.ids
            return
        place = int(common[0])
        yield left.ids[left.at(splice) : left.at(place)]
        left, splice, following = right, place, following + chunk
        if left.end < n and left.end < following + overlap:
            left = _Chunk(library, text, splice, min(n, following + overlap))


def _counts(names: str, batches: Iterator[pa.RecordBatch], huge: int, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    pieces = None
    for batch in batches:
        texts = batch.column("text")
        n_bytes = pc.binary_length(texts.fill_null("")).cast(pa.int64())
        if names.endswith(".model"):
            import sentencepiece

            pieces = pieces or sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(names))
            n = np.array([len(pieces.encode(x or "", num_threads=1)) for x in texts.to_pylist()], dtype=np.int64)
        else:
            pieces = pieces or encoder(names)
            n = _json_counts(pieces, texts, huge, chunk, overlap)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])


def _json_counts(pieces: PieceEncoder, texts: pa.Array, huge: int, chunk: int, overlap: int) -> np.ndarray:
    n = np.zeros(len(texts), np.int64)
    large = pc.fill_null(pc.greater(pc.utf8_length(texts), huge), False).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, bool)
    if (~large).any():
        n[~large] = pieces.counts(texts.filter(pa.array(~large)))
    for i in np.flatnonzero(large):
        n[i] = sum(map(len, resynchronised(pieces.library, texts[int(i)].as_py(), chunk, overlap)))
    return n


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, huge: int = 32_768, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row of docs; documents over `huge` code points are encoded in chunks."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counts(tokenizer, it, huge, chunk, overlap), "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", counts.n_tokens > 512)
