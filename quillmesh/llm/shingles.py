"""Word shingle sets of whole texts as 64-bit hashes, computed on Arrow buffers without Python strings.

A word is hashed in steps of eight bytes with a bijective mixing between them, long words by blake2b; a
single step is one to one, so words of up to eight bytes of one length never collide.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = b" \t\n\x0b\x0c\r"
_BLANK = re.compile(b"[ \t-\r]")
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LENGTH, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONG_WORD = 256  # bytes from which words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the concatenated texts, and how many words lie before each text's start.

    A-Z is lower-cased; words are runs without U+0020 and U+0009 to U+000D. ``bounds`` are the byte
    offsets of the texts.
    """
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = solid[inner]  # a text starts a word of its own
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), before
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    sizes = np.flatnonzero(last) + 1 - starts
    lower = np.zeros(len(data) + 8, dtype=np.uint8)
    lower[:-8] = _LOWER[data]
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=lower, strides=(1,))  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        value = mix(sizes.astype(np.uint64) * _LENGTH)
        at, todo = starts, np.arange(len(starts))
        for step in range(0, LONG_WORD, 8):
            left = sizes[todo] - step
            part = eights[at + step] & (_FULL >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
            value[todo] = mix((value[todo] ^ part) * _NEXT)
            more = left > 8
            if not more.any():
                break
            at, todo = at[more], todo[more]
    for i in np.flatnonzero(sizes > LONG_WORD):
        word = lower[starts[i] : starts[i] + sizes[i]]
        value[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8, key=b"word").digest(), dtype="<u8")[0]
    return value, before


def _only_shingle(data: np.ndarray, k: int) -> bytes:
    """128-bit digest of a text's first ``k`` words, lower-cased and joined by spaces."""
    words, rest = [], _LOWER[data].tobytes()
    while rest and len(words) < k:
        rest = rest.lstrip(_BLANKS)
        found = _BLANK.search(rest)
        end = found.start() if found else len(rest)
        words.append(rest[:end])
        rest = rest[end:]
    return hashlib.blake2b(b" ".join(w for w in words if w), digest_size=16).digest()


def set_digest(shingles: np.ndarray, only: bytes | None) -> np.ndarray:
    """Two 64-bit numbers that stand for a set; a set of one shingle goes by the words themselves."""
    return np.frombuffer(only or hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), dtype="<i8")


def shingle_sets(column: pa.Array, k: int):
    """Yield the sorted distinct shingle hashes (uint64) of each text of an Arrow string column."""
    return (found for found, _ in sets_with_digests(column, k, False))


def sets_with_digests(column: pa.Array, k: int, digests: bool = True):
    """Yield for each text its sorted distinct shingle hashes, and the digest of its only shingle if it has one.

    A text with fewer than ``k`` words, but one at least, has its whole word sequence as one shingle;
    null texts and texts without words have none.
    """
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    part = 1 << 20  # bytes at a time, so that temporary arrays stay small
    n, i = len(column), 0
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None and n else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + part, side="right")) - 1)
            j = min(j, n)
            words, before = _words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            mixed = np.zeros(0, dtype=np.uint64)
            if len(words) >= k:
                mixed = words[: len(words) - k + 1].copy()
                for step in range(1, k):
                    mixed = mix(mixed) + words[step : len(words) - k + 1 + step]
                mixed = mix(mixed + np.uint64(k))
            for d in range(j - i):
                lo, hi = before[d], before[d + 1]
                if not valid[i + d] or hi == lo:
                    found = np.zeros(0, dtype=np.uint64)
                elif hi - lo < k:
                    h = words[lo : lo + 1].copy()
                    for step in range(1, hi - lo):
                        h = mix(h) + words[lo + step : lo + step + 1]
                    found = mix(h + np.uint64(hi - lo))
                else:
                    found = np.unique(mixed[lo : hi - k + 1])
                yield found, _only_shingle(raw[offsets[i + d] : offsets[i + d + 1]], k) if digests and len(found) == 1 else None
            i = j
