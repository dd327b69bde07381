"""Token ids of Arrow string batches by the tokenizers library, with each distinct piece encoded once.

A byte-level BPE splits a text by its pre-token pattern and merges within each piece only, so a piece has
the same ids wherever it stands. Batches are cut into pieces by comparing bytes, each distinct piece goes through
the library, and its ids are kept in a bounded memo of the worker. The cutting is used only where it is known
to equal the library's: texts of ASCII and the Latin blocks, without special-token strings or doubled white space, for a tokenizer of
the standard byte-level form. Every other text is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.textvec import buffers

# Fixed values of the byte-level pre-token pattern, for the Latin code points up to U+024F:
#   's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
#: Texts with any of these are not cut here: other characters, or two white-space characters in a row.
WHOLE = "[^\\t\\n\\r\\x20-\\x7e¡-¬®-ɏ]|\\s\\s"

_SPACE, _BREAK, _LETTER, _NUMBER, _OTHER = range(5)
_SHORT = np.frombuffer(b"stmd", dtype=np.uint8)


def _kinds() -> np.ndarray:
    letter, number = re.compile(f"[{LETTERS}]"), re.compile(f"[{NUMBERS}]")
    return np.array([_SPACE if c == " " else _BREAK if c in "\t\n\r" else _LETTER if letter.match(c) else _NUMBER if number.match(c) else _OTHER for c in map(chr, range(0x250))], dtype=np.uint8)


_LATIN_KIND = np.concatenate([_kinds(), np.full(0x800 - 0x250, _OTHER, np.uint8)])
_BYTE_KIND = np.concatenate([_LATIN_KIND[:0x80], np.full(0x80, _OTHER, np.uint8)])

_loaded: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers by name, or any path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> PieceEncoder:
    """One encoder of a process and file."""
    if name not in _loaded:
        _loaded[name] = PieceEncoder(tokenizer_path(name))
    return _loaded[name]


class PieceEncoder:
    def __init__(self, path: str, memo: int = 1_000_000, part_bytes: int = 1 << 22):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        form = json.loads(self.library.to_str())
        pre = form.get("pre_tokenizer") or {}
        self.cuttable = form.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and form["model"]["type"] == "BPE" and not form["model"].get("ignore_merges")
        special = [re.escape(x["content"]) for x in form.get("added_tokens", [])]
        self.longest_special = max([0, *(len(x["content"]) for x in form.get("added_tokens", []))])
        self.whole = "|".join([WHOLE, *special])
        self.joinable = not any(" " in x["content"] for x in form.get("added_tokens", []))
        self.memo, self.part_bytes = memo, part_bytes
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.begin = np.zeros(1 << 16, dtype=np.int64)
        self.flat = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _encoded(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and how many each has.

        Pieces that start with a space and have no other white space end where the next one starts, whatever stands before, so that
        they are encoded as one text; the library tells which of its words an id belongs to. Should it find another number of
        words, they are encoded one by one, as all other pieces are.
        """
        if self.joinable and all(p[0] == " " and len(p) > 1 for p in part):
            e = self.library.encode("".join(part), add_special_tokens=False)
            words = np.array(e.word_ids, dtype=np.float64)  # null for an id outside of words
            if len(words) and not np.isnan(words).any() and words[-1] == len(part) - 1:
                counts = np.bincount(words.astype(np.int64), minlength=len(part))
                if len(counts) == len(part) and counts.all():
                    return np.array(e.ids, dtype=np.uint32), counts
        ids = [e.ids for e in self.library.encode_batch_fast(part, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(counts.sum())), counts

    def _learn(self, pieces: list[str]) -> None:
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1]
        for group in (spaced, [p for p in pieces if p[0] != " " or len(p) == 1]):
            for lo in range(0, len(group), 5000):
                part = group[lo : lo + 5000]
                ids, lengths = self._encoded(part)
                n, total = len(self.at), len(ids)
                while n + len(part) > len(self.count):
                    self.count, self.begin = np.resize(self.count, 2 * len(self.count)), np.resize(self.begin, 2 * len(self.begin))
                while self.used + total > len(self.flat):
                    self.flat = np.resize(self.flat, 2 * len(self.flat))
                self.count[n : n + len(part)] = lengths
                self.begin[n : n + len(part)] = self.used + np.cumsum(lengths) - lengths
                self.flat[self.used : self.used + total] = ids
                self.used += total
                self.at.update(zip(part, range(n, n + len(part))))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts in order (binary), and each row's first piece (rows + 1).

        No text here has two white-space characters in a row, so one before other characters is a piece of
        its own, or a space that goes with what follows.
        """
        data, off = buffers(texts)
        n = len(data)
        kind = _BYTE_KIND[data]
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            kind[lead] = kind[lead + 1] = _LATIN_KIND[((data[lead].astype(np.int32) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        start = np.ones(n + 1, dtype=bool)
        start[1:n] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        start[off] = True
        row_start = np.zeros(n + 3, dtype=bool)
        row_start[off] = True
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        mark = np.flatnonzero((data == 0x27) & start[:n])
        mark = mark[~row_start[mark + 1]]
        one, two = padded[mark + 1], np.where(row_start[mark + 2], 0, padded[mark + 2])
        short = np.isin(one, _SHORT)
        long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        start[mark[short | long] + 1] = False
        start[mark[long] + 2] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
        at = np.flatnonzero(start)
        pieces = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return pieces, np.searchsorted(at, off)

    def _indexed(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Memo places of all pieces of the texts, and each row's first."""
        pieces, first = self._cut(texts)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.cast(pa.string()).to_pylist()
        if len(self.at) + len(words) > self.memo and len(self.at) > 1:
            self._clear()
        at = self.at
        new = [w for w in words if w not in at]
        if new:
            self._learn(new)
        place = np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))
        return place[np.asarray(coded.indices)], first

    def _parts(self, texts: pa.Array):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.fill_null("") if texts.null_count else texts
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + self.part_bytes, side="right")))
            yield texts.slice(lo, hi - lo)
            lo = hi

    def _split(self, texts: pa.Array) -> np.ndarray:
        """Which texts are cut into pieces here."""
        return ~pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.cuttable else np.zeros(len(texts), dtype=bool)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; null counts as empty."""
        out = [np.zeros(0, np.int64)]
        for part in self._parts(texts):
            n = np.zeros(len(part), np.int64)
            cut = self._split(part)
            if cut.any():
                place, first = self._indexed(part.filter(pa.array(cut)))
                total = np.concatenate([[0], np.cumsum(self.count[place])])
                n[cut] = total[first[1:]] - total[first[:-1]]
            if not cut.all():
                n[~cut] = [len(e.ids) for e in self.library.encode_batch_fast(part.filter(pa.array(~cut)).to_pylist(), add_special_tokens=False)]
            out.append(n)
        return np.concatenate(out)

    def ids(self, texts: pa.Array):
        """For each part of the texts: all its ids (uint32) and each row's first (rows + 1)."""
        for part in self._parts(texts):
            cut = self._split(part)
            if cut.all():
                place, first = self._indexed(part)
                n = self.count[place]
                yield self.flat[_ranges(self.begin[place], n)], np.concatenate([[0], np.cumsum(n)])[first]
            else:
                place, first = self._indexed(part.filter(pa.array(cut))) if cut.any() else (np.zeros(0, np.int64), np.zeros(1, np.int64))
                n = self.count[place]
                flat, begin = self.flat[_ranges(self.begin[place], n)], np.concatenate([[0], np.cumsum(n)])[first]
                rest = iter(self.library.encode_batch_fast(part.filter(pa.array(~cut)).to_pylist(), add_special_tokens=False))
                rows, k = [], 0
                for c in cut:
                    rows.append(flat[begin[k] : begin[k + 1]] if c else np.array(next(rest).ids, dtype=np.uint32))
                    k += c
                yield np.concatenate(rows), np.cumsum([0, *map(len, rows)])


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for count[i] places, for all i in a row."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(begin - (end - count), count) + np.arange(total)
