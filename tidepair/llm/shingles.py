"""Hashes of words and shingles as NumPy arrays, for work inside tasks."""

from __future__ import annotations

import functools

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a sequence; equal spans get equal hashes wherever they stand.

    A polynomial over the values, read off from running sums and moved to power 0. Values have to be above 0.
    """
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values.astype(np.uint64) * up[: len(values)], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD)


@functools.cache
def gaps() -> np.ndarray:
    """Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


@functools.cache
def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of an UTF-8 text, A-Z lower-cased, in order."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~gaps()[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return span_hashes(ascii_lower()[raw].astype(np.uint64) + np.uint64(1), edges[0::2], edges[1::2])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words; fewer words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = (out + words[i : n - k + 1 + i]) * ODD + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(k))


def word_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after the other, and where each text's words begin (one entry more than texts)."""
    joined = b"\n".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], ~gaps()[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    hashes = span_hashes(ascii_lower()[raw].astype(np.uint64) + np.uint64(1), edges[0::2], edges[1::2])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(edges[0::2], starts)


def slices(text: bytes, size: int) -> list[bytes]:
    """A text in parts of about size bytes that end before a gap between words."""
    out, at, gap = [], 0, gaps()
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not gap[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]
