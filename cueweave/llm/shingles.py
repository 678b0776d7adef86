"""Shingle sets of many texts at once.

Texts lie end to end in one array of bytes; words, shingles and sets are cut from it by array operations, in stretches of
bounded size. Words are runs of bytes other than white space, A-Z lowered. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .decontaminate import grams

# Bytes that part words, and bytes with A-Z lowered.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWERED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes of text that are cut at a time; a longer text is cut by itself.
STRETCH = 1 << 22
#: Words of more bytes are hashed one by one.
LONG = 64

ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = (h ^ (h >> np.uint64(31))) * odd
    return x ^ (x >> np.uint64(29))


def begins(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive pieces of these sizes begins, and the end of the last."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that begin at ``at`` in ``data``, and how many each text has.

    Different words of up to eight bytes have different hashes.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    gap, edge = SPACE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    end = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = LOWERED[data]
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    size = end - start
    out = size.astype(np.uint64) * ODD2
    short = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        short = short[size[short] > k]
        if len(short) == 0:
            break
        left = np.minimum(size[short] - k, 8).astype(np.uint64)
        piece = eights[start[short] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[short] = mixed(out[short] ^ piece, ODD)
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(padded[start[i] : end[i]].tobytes())
    return out, np.diff(np.searchsorted(start, at))


def sets_of_words(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, set after set, and where each set begins."""
    at, number = begins(counts), np.where(counts >= size, counts - size + 1, counts > 0)
    place = begins(number)
    text = np.repeat(np.arange(len(counts)), counts)
    whole = text[: max(0, len(words) - size + 1)] == text[size - 1 :]
    out, usual = np.empty(place[-1], np.uint64), np.ones(place[-1], bool)
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        out[place[few]] = grams(words[at[few][:, None] + np.arange(n)].ravel(), n)[::n]
        usual[place[few]] = False
    out[usual] = grams(words, size)[whole]
    for a, b in zip(place[:-1], place[1:]):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[place[:-1][number > 0]] = True
    return out[new], begins(new)[place]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, hashes, begins: the sets of the texts from ``first`` to ``end``, stretch after stretch."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    _, places, content = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + STRETCH, "right")) - 1)
        words, counts = word_hashes(data[at[first] : at[end]], at[first : end + 1] - at[first])
        yield first, end, *sets_of_words(words, counts, size)
        first = end
