"""Hashes of words and of word sequences, for whole Arrow columns of texts at a time.

The bytes of many texts are one NumPy array; a word's 64-bit hash comes from prefix sums of a
polynomial over its bytes, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes hashed at once (longer texts make a slice of their own).
SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: Kinds of bytes for text split at punctuation: 0 space, 1 letters, digits and all beyond ASCII, 2 the rest.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[SPACE] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers for the first, second, ... word of a sequence; sequences have MOST_WORDS at most.
MOST_WORDS = 64
PLACES = mix(np.arange(1, MOST_WORDS + 1, dtype=np.uint64) * BASE) | np.uint64(1)


@lru_cache(maxsize=1)  # a longer text's table takes the place of the usual one, until the next slice
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, inverse = 1 << bits, np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(19, int(n).bit_length()))


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of slices of a column; nulls are empty texts."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, by_kind: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and each text's first word (one more for the end).

    Words are runs without white space, or with ``by_kind`` runs of letters or of punctuation.
    """
    kind = KIND[data] if by_kind else (~SPACE[data]).view(np.uint8)
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    if not len(data):
        bounds = bounds[:1]
    starts, ends = bounds[:-1], bounds[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACES[4])


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True, by_kind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased if ``fold``, and each text's first word."""
    data = FOLD[data] if fold else data
    starts, ends, first = spans(data, offsets, by_kind)
    return hashes(data, starts, ends), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``words`` words in a row.

    A text with fewer words has the whole sequence as its one shingle; one without words has none.
    """
    if not 0 < words <= MOST_WORDS:
        raise ValueError(f"a shingle has 1 to {MOST_WORDS} words")
    word, first = word_hashes(data, offsets)
    rows = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for k in range(words):
        rows += word[k : k + len(rows)] * PLACES[k]
    rows = mix(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rows[a : b - words + 1]))
        elif b > a:
            short = (word[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([b - a], dtype=np.uint64) * PLACES[3]))
        else:
            out.append(rows[:0])
    return out
