"""Vectorised text kernels on Arrow buffers: word hashes, shingle sets, mixing.

Every function works on a chunk of texts at once with numpy; no Python loop runs
per word.  ASCII texts never leave the Arrow buffer; others are folded by Python
first (lower case and white space, or NFKC for the letter-and-digit words).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; bounds every temporary array of the kernels.
CHUNK_BYTES = 1 << 20

_UNICODE_BLANKS = re.compile("[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_INVISIBLE = re.compile("[\u00ad\u200b\u2060\ufeff]")
_NOT_WORD = re.compile(r"[\W_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style) of an unsigned array."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)
    if lower:
        values[65:91] = values[97:123]
    values[np.frombuffer(separators, dtype=np.uint8)] = 0
    return values


_BLANK_BYTES = bytes([9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: Words between blanks, and words of letters and digits only (bytes from 128 up are letters after folding).
BLANK_WORDS = _byte_table(_BLANK_BYTES)
ALNUM_WORDS = _byte_table(bytes(i for i in range(128) if not chr(i).isalnum()))

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE, dtype=U64), np.full(size, _INVERSE, dtype=U64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def fold_blank(text: str) -> str:
    """Lower case, with every Unicode blank as an ASCII one."""
    return _UNICODE_BLANKS.sub(" ", text.lower())


def fold_alnum(text: str) -> str:
    """NFKC, without soft hyphens and zero-width characters, lower case, words joined by blanks."""
    return _NOT_WORD.sub(" ", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower())


def chunks(texts: pa.Array, fold, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null counts as an empty text.

    Rows with bytes from 128 up are folded by ``fold`` first.  A chunk holds at
    least one row, so a very long text makes a chunk of its own.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    null = np.asarray(texts.is_null()) if texts.null_count else None
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        last = min(last, n)
        part = data[offsets[row] : offsets[last]]
        starts = offsets[row : last + 1] - offsets[row]
        high = part >= 128
        if high.any() or (null is not None and null[row:last].any()):
            seen = np.concatenate(([0], np.cumsum(high)))
            wide = seen[starts[1:]] > seen[starts[:-1]]
            pieces = []
            for i in range(last - row):
                if null is not None and null[row + i]:
                    pieces.append(b"")
                elif wide[i]:
                    pieces.append(fold(bytes(part[starts[i] : starts[i + 1]]).decode("utf-8", "replace")).encode("utf-8", "replace"))
                else:
                    pieces.append(part[starts[i] : starts[i + 1]].tobytes())
            starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)
            part = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        yield row, part, starts
        row = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk, and the word offsets of its texts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    up, down = _power_tables(n + 1)
    values = table[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][(offsets[:-1] < n) & (offsets[1:] > offsets[:-1])]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[at[at > 0] - 1] = inside[at[at > 0] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    sums = np.cumsum(values * up[:n], dtype=U64)
    before = np.where(first > 0, sums[first - 1], U64(0))
    hashes = mix((sums[last] - before) * down[first] + (last - first).astype(U64))
    return hashes, np.searchsorted(first, offsets).astype(np.int64)


_STEP = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)]


def _factor(i: int) -> np.uint64:
    return _STEP[i] if i < len(_STEP) else U64(((0xE7037ED1A0B428DB * (2 * i + 1)) | 1) & 0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per text, repeated ones included.

    A text of fewer words has one shingle of all its words; one without words none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= size, lengths - size + 1, (lengths > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    total = int(out[-1])
    if total == 0:
        return np.zeros(0, U64), out
    starts = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(total)
    rolled = np.zeros(total, U64)
    padded = np.concatenate((words, np.zeros(size, U64)))
    for i in range(size):
        rolled += padded[starts + i] * _factor(i)
    rolled = mix(rolled)
    for text in np.flatnonzero((lengths > 0) & (lengths < size)):
        w = words[offsets[text] : offsets[text + 1]]
        short = U64(len(w))
        for i, x in enumerate(w):
            short = U64((int(short) + int(x) * int(_factor(i))) & 0xFFFFFFFFFFFFFFFF)
        rolled[out[text]] = mix(np.array([short ^ U64(0x5851F42D4C957F2D)], U64))[0]
    return rolled, out


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    values = values.copy()
    for i in range(len(offsets) - 1):
        values[offsets[i] : offsets[i + 1]].sort()
    if not len(values):
        return values, offsets
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[offsets[:-1][offsets[:-1] < len(values)]] = True
    sums = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], sums[offsets].astype(np.int64)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, offsets): the sorted set of word shingles of every text, chunk by chunk."""
    for row, data, offsets in chunks(texts, fold_blank):
        words, word_offsets = word_hashes(data, offsets, BLANK_WORDS)
        yield row, *distinct_sorted(*shingles(words, word_offsets, size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 0 where either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)
