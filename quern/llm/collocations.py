"""Phrases of two to four words that stand together far more often than apart, per language.

Texts are cut at punctuation and line ends into pieces, and those at blanks into words. A first scan counts words, a
second one pairs of frequent words and a third one triples of frequent pairs, by 64-bit hash: what is seen often enough sets a bit
in a bitmap of bounded size. Hashes and bits can only let too much through, never too little, since a phrase is never seen more
often than a part of it. The last scan builds a generalised suffix automaton of each shard's pieces, as deep at
each word as its parts are frequent, and gives the exact counts of its substrings of at most four words, as text; Spark adds
them up.

The automaton is built from its link tree: word positions are grouped by the last word, the last two and so on up to
the depth. Groups of one end set are one state, from its shortest to its longest string; the size of that set
is its count, and its suffix link leads to the state of the strings one word shorter than its shortest.

Subsumption follows the links of the phrases kept, on both ends: the phrase without its first word (its suffix link, or
a shorter string of its own state) and without its last. One step is enough: a phrase inside a longer one is inside a phrase one
word longer that is seen as least as often.

Null texts count as empty; a null lang is `und`; repeated rows count as often as they stand; an empty table gives no row;
doc_id and other columns are not read, so their names can't clash. Long texts are read in parts cut at piece ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.shared import Scratch, small_batches, table
from quern.llm.textvec import LOWER, Words, mix

DEPTH = 4


def _bytes_table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


#: Bytes that end a piece, and those that end a word.
ENDS = _bytes_table(b".,;:!?\n\x0b\x0c\r")
BLANKS = ENDS | _bytes_table(b" \t")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _parts(texts: pa.Array, langs: pa.Array, most: int) -> Iterator[tuple[pa.Array, np.ndarray, list[str]]]:
    """Texts in parts of about `most` bytes, with each row's place in a list of languages; longer texts are cut at piece ends."""
    coded = langs.fill_null("und").dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 1 and size[hi - 1] > most:  # a long text stands alone
            yield texts.slice(lo, hi - lo - 1), code[lo : hi - 1], names
            lo = hi - 1
        if size[lo] <= most or hi - lo > 1:
            yield texts.slice(lo, hi - lo), code[lo:hi], names
            continue
        data = np.frombuffer(texts[lo].as_buffer(), dtype=np.uint8)
        at = 0
        while at < len(data):
            end = min(len(data), at + most)
            while end < len(data):
                found = np.flatnonzero(ENDS[data[end : end + most]])
                if len(found):
                    end += int(found[0])
                    break
                end = min(len(data), end + most)
            yield pa.array([data[at:end].tobytes()], pa.binary()), code[lo : lo + 1], names
            at = end


class _Stream:
    """The words of one part: hashes seeded by language, the piece of each, and its language's place in names."""

    def __init__(self, texts: pa.Array, code: np.ndarray, names: list[str]):
        self.words = Words(texts, BLANKS)
        w = self.words
        self.names, self.lang = names, code[w.row]
        ends = np.cumsum(ENDS[w.bytes], dtype=np.int64)
        self.piece = ends[w.start] + w.row if len(w.start) else np.zeros(0, np.int64)
        seeds = np.array([_seed(x) for x in names] or [0], dtype=np.uint64)
        self.hash = mix(w.hash ^ seeds[self.lang])

    def neighbours(self) -> np.ndarray:
        """Whether each word but the first stands in one piece with the word before it."""
        return self.piece[:-1] == self.piece[1:]

    def context(self, bits: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of how many words (up to depth) the longest string is that ends at each word and is counted, and the hash of the string of
        `depth` words. bits[d - 1]: the frequent strings of d words; longer ones count if both their parts of one word less are frequent."""
        n = len(self.hash)
        often = _set(bits[0], self.hash) if bits else np.ones(n, dtype=bool)
        size, string = often.astype(np.int8), self.hash
        for d in range(2, depth + 1):
            # Both parts of one word less are frequent, and the strings are in one piece.
            ends = 1 + np.flatnonzero(often[1:] & often[:-1] & self.neighbours())
            with np.errstate(over="ignore"):
                longer = mix(string[ends - 1] * _FACTOR + self.hash[ends])
            string = np.zeros(n, dtype=np.uint64)
            string[ends] = longer
            often = np.zeros(n, dtype=bool)
            # Where no bitmap tells which strings are frequent, all of them count.
            often[ends] = _set(bits[d - 1], longer) if d <= len(bits) else True
            size[often] = d
        return size, string


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _streams(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[_Stream]:
    for batch in batches:
        if len(batch):
            for texts, code, names in _parts(batch.column("text").cast(pa.binary()), batch.column("lang"), part_bytes):
                yield _Stream(texts, code, names)


def _hash_counts(batches: Iterator[pa.RecordBatch], sent: list, part_bytes: int, shard: int) -> Iterator[pa.RecordBatch]:
    """Hashes and counts of the strings one word longer than those of the last bitmap sent; a row per hash and shard."""
    bits = [np.frombuffer(b.value, dtype=np.uint8) for b in sent]
    held, n = [], 0

    def counted():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    for s in _streams(batches, part_bytes):
        if not len(s.hash):
            continue
        size, string = s.context(bits, len(bits) + 1)
        held.append(string[size == len(bits) + 1])
        n += len(held[-1])
        if n >= shard:
            yield counted()
            held, n = [], 0
    if n:
        yield counted()


class Automaton:
    """The suffix automaton, to a depth, of word ids: context[i] is the number of words of the longest string that ends at i.

    A state has the strings of `shortest` to `longest` words that end at position `end` (and at count - 1 others); link is the
    state of the next shorter suffix, -1 for the root.
    """

    def __init__(self, ids: np.ndarray, context: np.ndarray, depth: int = DEPTH):
        n = len(ids)
        base = int(ids.max()) + 1 if n else 1
        at, group = np.arange(n), None  # positions with a context of this length, and their groups
        ends, longest, shortest, counts, links = [], [], [], [], []
        state_of = np.zeros(0, np.int64)  # of each group one word shorter
        made = 0
        for d in range(1, depth + 1):
            if d == 1:
                key = ids.astype(np.int64)
            else:
                more = context[at] >= d
                at, before = at[more], group[more]
                key = before * base + ids[at - d + 1]
            _, first, now, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            if d == 1:
                state_of, made = np.arange(len(size)), len(size)
                parent, same = np.full(len(size), -1), np.zeros(len(size), bool)
            else:
                parent = before[first]
                same = size == was[parent]  # the same end set: the state of the shorter string grows
                old = state_of[parent]
                grown = old[same]
                all_longest[grown] = d
                state_of = np.where(same, old, made + np.cumsum(~same) - 1)
                made += int((~same).sum())
                parent = old
            new = ~same
            ends.append(at[first][new])
            shortest.append(np.full(int(new.sum()), d))
            counts.append(size[new])
            links.append(parent[new])
            all_longest = np.concatenate([all_longest, np.full(int(new.sum()), d)]) if d > 1 else np.full(len(size), 1)
            group, was = now, size
        self.end, self.shortest, self.count, self.link = map(np.concatenate, (ends, shortest, counts, links))
        self.longest = all_longest

    def substrings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, words and count of each distinct string."""
        many = self.longest - self.shortest + 1
        state = np.repeat(np.arange(len(many)), many)
        length = np.arange(len(state)) - np.repeat(np.cumsum(many) - many, many) + self.shortest[state]
        return self.end[state], length, self.count[state]


class _Shard:
    """Words of several parts by id, with the text of each word, until an automaton takes them."""

    def __init__(self):
        self.hashes, self.sizes, self.known, self.texts, self.langs, self.n = [], [], np.zeros(0, np.uint64), [], [], 0

    def add(self, s: _Stream, size: np.ndarray) -> None:
        """Takes the words with a context; a word without one stands in no string of two."""
        keep = size > 0
        h = s.hash[keep]
        new, first = np.unique(h, return_index=True)
        unknown = ~np.isin(new, self.known)
        place = np.flatnonzero(keep)[first[unknown]]
        w = s.words
        self.texts += [LOWER[w.bytes[a:b]].tobytes() for a, b in zip(w.start[place].tolist(), w.end[place].tolist())]
        self.langs += [s.names[i] for i in s.lang[place].tolist()]
        self.known = np.concatenate([self.known, new[unknown]])
        self.hashes.append(h)
        self.sizes.append(size[keep])
        self.n += len(h)

    def counts(self, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        order = np.argsort(self.known, kind="stable")
        ids = order[np.searchsorted(self.known, np.concatenate(self.hashes), sorter=order)]
        end, length, count = Automaton(ids, np.concatenate(self.sizes)).substrings()
        words, langs = pa.array(self.texts, pa.binary()), pa.array(self.langs, pa.string())
        for d in range(1, DEPTH + 1):
            here = np.flatnonzero(length == d)
            for lo in range(0, len(here), rows):
                at, f = end[here[lo : lo + rows]], count[here[lo : lo + rows]]
                phrase = pc.binary_join_element_wise(*[words.take(pa.array(ids[at - k])) for k in range(d - 1, -1, -1)], pa.scalar(b" ")).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[at])), phrase, pa.array(np.full(len(at), d, np.int32)), pa.array(f.astype(np.int64))], ["lang", "phrase", "words", "f"])


def _phrase_counts(batches: Iterator[pa.RecordBatch], sent: list, part_bytes: int, shard: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words and f of each shard; of no words: all words of the language in it."""
    bits = [np.frombuffer(b.value, dtype=np.uint8) for b in sent]
    held, total = _Shard(), {}
    for s in _streams(batches, part_bytes):
        if not len(s.hash):
            continue
        for code, n in zip(*np.unique(s.lang, return_counts=True)):
            total[s.names[code]] = total.get(s.names[code], 0) + int(n)
        held.add(s, s.context(bits, DEPTH)[0])
        if held.n >= shard:
            yield from held.counts()
            held = _Shard()
    if held.n:
        yield from held.counts()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([""] * len(total)), pa.array([0] * len(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["lang", "phrase", "words", "f"])


def _bitmap(hashes: DataFrame, most_bits: int) -> bytes:
    """A bitmap of column h, of 16 bits a hash, but at most most_bits: more hashes let more through and lose none."""
    n = hashes.count()
    size = min(most_bits, 1 << max(10, (16 * n).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    cells = hashes.select(F.shiftright(at, 6).alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, dtype=np.int64)
    out[cells["i"].to_numpy()] = cells["bits"].to_numpy()
    return out.astype("<i8").tobytes()


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = 30, most_bits: int = 1 << 28, part_bytes: int = 1 << 20, shard: int = 1 << 20) -> DataFrame:
    """lang, phrase, words and f, exactly, of all phrases of up to four words with f >= least, and each language's words at words 0.

    The three bitmaps that go to all tasks have at most most_bits bits each. A shard has about `shard` words or hashes.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    sent = []
    for _ in range(1, DEPTH):
        counts = texts.mapInArrow(lambda it, sent=tuple(sent): _hash_counts(it, sent, part_bytes, shard), "h long, c long")
        often = scratch.stored(counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h"), "frequent")
        sent.append(sc.broadcast(_bitmap(often, most_bits)))
    counts = texts.mapInArrow(lambda it: _phrase_counts(it, sent, part_bytes, shard), "lang string, phrase string, words int, f long")
    return counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase that stands inside a longer one which is seen at least covered/100 as often is left out.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.stored(phrase_counts(docs, scratch, least), "phrases")
        phrases = counts.where("words > 0")
        parts = F.split("phrase", " ")
        found = phrases.where("words > 1").withColumn("_w", parts).withColumnRenamed("f", "a")
        cut = lambda lo, n: F.array_join(F.slice("_w", lo, n), " ")
        cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), cut(F.lit(1), k).alias("first"), cut(k + 1, F.col("words") - k).alias("rest"))))
        sides = phrases.select("lang", "phrase", "f")
        one = found.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.*")
        one = one.join(sides.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(sides.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        exact = F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r) as long)")
        scored = one.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.score", "low.l", "low.r")
        inside = found.where("words > 2").select("lang", "a", F.explode(F.array(cut(F.lit(2), F.col("words") - 1), cut(F.lit(1), F.col("words") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = scored.join(inside, ["lang", "phrase"], "left").where("longer is null or cast(100 as decimal(5,0)) * cast(longer as decimal(20,0)) < cast(a as decimal(20,0)) * {}".format(int(covered)))
        order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
        out = ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return scratch.stored(out, "collocations", keep=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {n} AS words, array_to_string(ws[i:i + {n - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM pieces WHERE len(ws) >= {n})" for n in range(1, 5))
#: Plain counting of all phrases, every cut of each, and the phrases that stand inside longer ones.
OP12_SQL = f"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM cut),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, f AS a, words, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM f WHERE words > 1),
halves AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, CAST(2000000 * c.a::HUGEINT // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
lowest AS (SELECT * FROM halves QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, f, string_split(phrase, ' ') AS ws, words, unnest(range(2, words)) AS size FROM f WHERE words > 2), LATERAL (SELECT unnest(range(1, words - size + 2)) AS i) GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN longer g ON g.lang = o.lang AND g.phrase = o.phrase WHERE g.f IS NULL OR 100 * g.f::HUGEINT < 80 * o.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
