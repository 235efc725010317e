"""Benchmark decontamination: SimHash of item-sized windows at every word, Hamming search, exact comparison.

Shared benchmark shingles first tell, without losses, where windows that resemble an item can lie."""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed
from .shingles import ODD, mixed, shingle_hashes, slices, word_hashes, word_stream

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of windows: lanes of 64 bits, and the Hamming distance up to which a window is compared exactly. At
#: similarity 0.8 a bit differs with probability 0.15, or 0.19 at most (4 of 5 shingles): more than NEAR of 256 bits do
#: with less than 1e-10. Unrelated windows differ in 128 bits, give or take 8.
LANES, NEAR = 4, 96
#: Windows fingerprinted at once.
WINDOWS_AT_ONCE = 1 << 12
#: 64-bit fingerprints within RADIUS bits have one of BLOCKS 16-bit blocks within RADIUS // BLOCKS bits: none is missed.
RADIUS, BLOCKS = 11, 4
#: Window sizes grow by RATIO; items above LONGEST words are cut into segments of at most that size.
RATIO, SHORTEST, LONGEST = 1.1, 5, 200
#: Items searched for at once, bytes of text handled at once, and (place, item) pairs looked at at once.
ITEMS_AT_ONCE, BYTES_AT_ONCE, PAIRS_AT_ONCE = 20_000, 1 << 19, 1 << 20
#: Leading bits of a shingle that a table of those in any item is kept by.
LEADING = 22

LOW = np.uint64(0x0101010101010101)


def lanes(shingles: np.ndarray) -> np.ndarray:
    """Running sums of the 64 bits, eight byte-sized counters to a lane: differences are right up to 255 shingles."""
    out = np.zeros((len(shingles) + 1, 8), np.uint64)
    np.cumsum((shingles[:, None] >> np.arange(8, dtype=np.uint64)) & LOW, axis=0, dtype=np.uint64, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, n) -> np.ndarray:
    """SimHash of n shingles (a number, or one per start) from each start: a bit is set if most of them have it."""
    votes = (sums[starts + n] - sums[starts]).view(np.uint8)
    half = (n // 2) if np.isscalar(n) else (n // 2).astype(np.uint8)[:, None]
    return np.packbits(votes > half, axis=1).view(np.uint64).ravel()


def element_bits(shingles: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The LANES * 64 bits of shingles, one row each. The second copy of a shingle is an element of its own, and so on: so
    bags are sets, and a shingle that repeats has no more votes than it has places."""
    lane = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    seeds = shingles + copies.astype(np.uint64) * ODD
    return np.unpackbits(mixed(seeds[:, None] + lane).view(np.uint8), axis=1)


def prints_of(votes: np.ndarray, n) -> np.ndarray:
    """SimHash of n elements: a bit is set if more than half of them have it."""
    return np.packbits(2 * votes > n, axis=1).view(np.uint64)


def window_prints(shingles: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the window of so many shingles from every place on: votes move on by the element that leaves and the
    one that comes."""
    n = len(shingles)
    _, k = np.unique(shingles, return_inverse=True)
    place = np.arange(n)
    keys = np.sort(k * (n + 1) + place)
    same = lambda at, low, high: np.searchsorted(keys, k[at] * (n + 1) + high) - np.searchsorted(keys, k[at] * (n + 1) + low)
    comes = element_bits(shingles, same(place, np.maximum(place - size + 1, 0), place))
    first = place[: n - size]
    goes = element_bits(shingles[first], same(first, first + 1, first + size))
    start = comes[:size].sum(axis=0, dtype=np.int32)
    moved = np.cumsum(comes[size:].astype(np.int32) - goes, axis=0)
    return prints_of(np.concatenate((start[None], start + moved)), size)


def near_windows(shingles: np.ndarray, size: int, own: np.ndarray) -> np.ndarray:
    """Places from which the window's fingerprint is within NEAR bits of an item's. Such a window is within NEAR // LANES in
    one lane at least, so lanes are looked at first."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(shingles) - size + 1, WINDOWS_AT_ONCE):
        apart = np.bitwise_count(window_prints(shingles[at : at + WINDOWS_AT_ONCE + size - 1], size) ^ own)
        some = np.flatnonzero(apart.min(axis=1) <= NEAR // LANES)
        out.append(at + some[apart[some].sum(axis=1, dtype=np.int64) <= NEAR])
    return np.concatenate(out)


def window_sizes() -> np.ndarray:
    sizes, x = [], float(SHORTEST)
    while not sizes or sizes[-1] < LONGEST:
        sizes.append(min(LONGEST, round(x)))
        x = max(x * RATIO, x + 1)
    return np.array(sizes)


@dataclass
class Class:
    """Items of about one size: fingerprints, and for each block the items near every value of it."""

    size: int
    prints: np.ndarray
    of: np.ndarray
    begin: list[np.ndarray]
    near: list[np.ndarray]


@dataclass
class Index:
    """Pieces are items, and for items above LONGEST words their segments too. known: the shingles of all pieces, sorted."""

    ids: list[int]
    sizes: np.ndarray
    known: np.ndarray
    some: np.ndarray  # leading bits that a known shingle has
    begin: np.ndarray  # piece i holds known shingles held[begin[i]:begin[i + 1]], in order, so many times each
    held: np.ndarray
    times: np.ndarray
    rare_begin: np.ndarray  # known shingle k is in the prefix of pieces rare[rare_begin[k]:rare_begin[k + 1]]
    rare: np.ndarray
    short: dict[int, list[int]]  # items of fewer words than a shingle, by their one shingle
    prints: np.ndarray  # fingerprints of the pieces, LANES numbers each

    @functools.cached_property
    def classes(self) -> list[Class]:
        """The pieces by 64-bit SimHash, for within_radius(); the search, which has to find all, goes by prints."""
        return hamming_classes(self)


def near_values(reach: int) -> np.ndarray:
    masks = np.arange(1 << 16)
    return masks[np.bitwise_count(masks.astype(np.uint16)) <= reach].astype(np.uint64)


def least_shared(n, m):
    """Shingles that bags of n and m share at least if they are similar: both / (n + m - both) >= SIMILARITY."""
    return np.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-6).astype(np.int64)


def build_index(items: list[tuple[int, str | None]]) -> Index:
    """Index of items; those without words can't be met and are left out.

    A window, which holds no more shingles than the piece, or the shorter whole text, is similar only if it lacks less
    than 1 - SIMILARITY of the piece's shingles. So it has at least one of any so many of them and one more: the prefix,
    for which those of the fewest pieces are taken.
    """
    ids, sizes, bags, short, prints = [], [], [], {}, []
    for name, text in items:
        words = word_hashes((text or "").encode())
        cuts = -(-len(words) // LONGEST)
        for piece in [*(np.array_split(words, cuts) if cuts > 1 else []), *([words] if cuts else [])]:
            s = shingle_hashes(piece, SHINGLE)
            if len(piece) < SHINGLE:
                short.setdefault(int(s[0]), []).append(name)
                continue
            ids.append(name)
            sizes.append(len(piece))
            bags.append(np.unique(s, return_counts=True))
            prints.append(window_prints(s, len(s))[0])
    begin = np.concatenate(([0], np.cumsum([len(s) for s, _ in bags]))).astype(np.int64)
    all_ = np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in bags)])
    times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in bags)])
    known, held, pieces = np.unique(all_, return_inverse=True, return_counts=True)
    some = np.zeros(1 << LEADING, bool)
    some[known >> np.uint64(64 - LEADING)] = True
    rare, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, size in enumerate(sizes):
        mine, n = slice(begin[i], begin[i + 1]), size - SHINGLE + 1
        order = np.argsort(pieces[held[mine]], kind="stable")
        enough = n - math.ceil(SIMILARITY * n - 1e-6) + 1
        order = order[: np.searchsorted(np.cumsum(times[mine][order]), enough) + 1]
        rare.append(held[mine][order])
        of.append(np.full(len(order), i))
    rare, of = np.concatenate(rare), np.concatenate(of)
    order = np.argsort(rare, kind="stable")
    rare_begin = np.concatenate(([0], np.cumsum(np.bincount(rare, minlength=len(known))))).astype(np.int64)
    return Index(ids, np.array(sizes, np.int64), known, some, begin, held, times, rare_begin, of[order], short, np.array(prints, np.uint64).reshape(-1, LANES))


def hamming_classes(index: Index) -> list[Class]:
    all_ = []
    for i in range(len(index.ids)):
        mine = slice(index.begin[i], index.begin[i + 1])
        s = np.repeat(index.known[index.held[mine]], index.times[mine])
        all_.append(fingerprints(lanes(s), np.zeros(1, np.int64), len(s))[0])
    known, classes, sizes = window_sizes(), [], index.sizes
    own = np.argmin(np.abs(known[None, :] - sizes.reshape(-1, 1)), axis=1) if len(sizes) else []
    reach = near_values(RADIUS // BLOCKS)
    for c in sorted(set(own)):
        of = np.flatnonzero(own == c)
        prints = np.array([all_[i] for i in of], np.uint64)
        begin, near = [], []
        for b in range(BLOCKS):
            block = (prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            values = (block[:, None] ^ reach[None, :]).ravel().astype(np.int64)
            order = np.argsort(values, kind="stable")
            near.append((order // len(reach)).astype(np.int32))
            begin.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << 16)))).astype(np.int64))
        classes.append(Class(int(known[c]), prints, of, begin, near))
    return classes


def within_radius(prints: np.ndarray, c: Class) -> tuple[np.ndarray, np.ndarray]:
    """All (window, item of the class) within RADIUS bits, each once or more."""
    windows, items = [], []
    for b in range(BLOCKS):
        value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        first = c.begin[b][value]
        n = c.begin[b][value + 1] - first
        hit = np.flatnonzero(n)
        n, first = n[hit], first[hit]
        w = np.repeat(hit, n)
        i = c.near[b][np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(hit) else np.zeros(0, np.int32)
        good = np.bitwise_count(prints[w] ^ c.prints[i]) <= RADIUS
        windows.append(w[good])
        items.append(i[good])
    return np.concatenate(windows), np.concatenate(items)


def best_window(at: np.ndarray, found: np.ndarray, low: int, high: int, size: int, piece: int, index: Index) -> tuple[int, int]:
    """Most shingles (as a bag) that a window of size shingles within [low, high) shares with a piece, and where; the first of equals.

    found: the known shingles at places at. One that the piece holds n times counts for the windows that hold it and fewer
    than n of the same before it.
    """
    mine = slice(index.begin[piece], index.begin[piece + 1])
    here = slice(*np.searchsorted(at, (low, high)))
    held, at, found = index.held[mine], at[here], found[here]
    k = np.minimum(np.searchsorted(held, found), len(held) - 1)
    own = held[k] == found
    k, at = k[own], at[own]
    order = np.argsort(k, kind="stable")
    k, at = k[order], at[order]
    before = np.arange(len(k)) - index.times[mine][k]
    same = np.maximum(before, 0)
    after = np.where((before >= 0) & (k[same] == k), at[same] + 1, low)
    first, last = np.maximum(np.maximum(after, at - size + 1), low), np.minimum(at, high - size)
    first, last = first[first <= last], last[first <= last]
    if not len(first):
        return 0, low
    places, which = np.unique(np.concatenate((first, last + 1)), return_inverse=True)
    both = np.cumsum(np.bincount(which[: len(first)], minlength=len(places)) - np.bincount(which[len(first) :], minlength=len(places)))
    return int(both.max()), int(places[both.argmax()])


def matches_of(words: np.ndarray, begin: np.ndarray, index: Index) -> list[tuple[int, int, float, int]]:
    """(text, item id, similarity, first word) of every item that a window of a text resembles by SIMILARITY or more.

    words: those of many texts, text i from begin[i] to begin[i + 1]. Windows stay inside texts; a text shorter than the
    window is one window. Where known shingles leave room for a similar window, all windows are fingerprinted; those near
    the item's fingerprint are compared exactly. Items of one shingle are met by that shingle's hash, which is all that
    their fingerprint would say.
    """
    out, size = [], np.diff(begin)
    for k in range(1, SHINGLE):
        if index.short and len(words) >= k:
            h = shingle_hashes(words, k)
            for at in np.flatnonzero(np.isin(h, np.array(list(index.short), np.uint64))).tolist():
                t = int(np.searchsorted(begin, at, "right")) - 1
                if at + k <= begin[t + 1]:
                    out += [(t, name, 1.0, at - int(begin[t])) for name in index.short[int(h[at])]]
    if len(words) < SHINGLE or not index.ids:
        return out
    shingles = shingle_hashes(words, SHINGLE)
    at = np.flatnonzero(index.some[shingles >> np.uint64(64 - LEADING)])
    found = np.minimum(np.searchsorted(index.known, shingles[at]), len(index.known) - 1)
    owner = np.searchsorted(begin, at, "right") - 1
    real = (index.known[found] == shingles[at]) & (at + SHINGLE <= begin[owner + 1])
    at, found, owner = at[real], found[real], owner[real]
    if not len(at):
        return out
    n = index.rare_begin[found + 1] - index.rare_begin[found]
    pairs = []
    lot = (np.cumsum(n) - n) // PAIRS_AT_ONCE
    for hits in np.split(np.arange(len(at)), np.flatnonzero(np.diff(lot)) + 1):
        h = np.repeat(hits, n[hits])
        i = index.rare[index.rare_begin[found[h]] + np.arange(len(h)) - np.repeat(np.cumsum(n[hits]) - n[hits], n[hits])]
        whole, full = size[owner[h]] - SHINGLE + 1, index.sizes[i] - SHINGLE + 1
        low = np.maximum(begin[owner[h]], at[h] - full + 1)
        high = np.minimum(begin[owner[h] + 1] - SHINGLE + 1, at[h] + full)
        near = np.searchsorted(at, high) - np.searchsorted(at, low)  # as many as any window there can share
        good = near >= least_shared(full, np.minimum(full, whole))
        pairs.append(np.stack((owner[h], i, low, high))[:, good])
    t, i, low, high = np.concatenate(pairs, axis=1)
    order = np.lexsort((low, i, t))
    t, i, low, high = t[order], i[order], low[order], high[order]
    fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (low[1:] >= high[:-1]))) if len(t) else np.zeros(0, bool)
    ends = np.flatnonzero(np.concatenate((fresh[1:], [True]))) if len(t) else np.zeros(0, int)
    for text, piece, left, right in zip(t[fresh].tolist(), i[fresh].tolist(), low[fresh].tolist(), high[ends].tolist(), strict=True):
        full = int(index.sizes[piece]) - SHINGLE + 1
        width = min(full, int(size[text]) - SHINGLE + 1)
        close = near_windows(shingles[left:right], width, index.prints[piece])
        if not len(close):
            continue
        left, right = left + int(close[0]), left + int(close[-1]) + width
        both, place = best_window(at, found, left, right, width, piece, index)
        score = both / (full + width - both)
        if score >= SIMILARITY:
            out.append((text, index.ids[piece], score, place - int(begin[text])))
    return out


def matches(texts: list[str | None], index: Index) -> list[dict[int, tuple[float, int]]]:
    """Per text: item id -> (best similarity, first word of the first such window)."""
    out: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
    longest = max(SHINGLE, *index.sizes.tolist(), 0)

    def search(names: list[int], bases: list[int], words: np.ndarray, begin: np.ndarray) -> None:
        for t, item, score, at in matches_of(words, begin, index):
            found, new = out[names[t]], (score, -(bases[t] + at))
            old = found.get(item)
            found[item] = new if old is None else max(old, new)

    batch, names, held = [], [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) > BYTES_AT_ONCE:  # a long text alone, in runs of words that overlap by the longest window
            words = np.concatenate([word_stream([part])[0] for part in slices(raw, BYTES_AT_ONCE)])
            for base in range(0, max(1, len(words) - longest), BYTES_AT_ONCE // 4):
                run = words[base : base + BYTES_AT_ONCE // 4 + longest]
                search([k], [base], run, np.array([0, len(run)]))
            continue
        batch.append(raw)
        names.append(k)
        held += len(raw)
        if held >= BYTES_AT_ONCE:
            search(names, [0] * len(names), *word_stream(batch))
            batch, names, held = [], [], 0
    if batch:
        search(names, [0] * len(names), *word_stream(batch))
    return [{item: (score, -at) for item, (score, at) in found.items()} for found in out]


HITS = "array<struct<item_id:long,similarity:double,first_word:long>>"


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", name: str = "hits", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds the benchmark items that each whole text holds, by item: (item_id, similarity, first_word).

    The items come to the driver and go to the tasks ITEMS_AT_ONCE at a time, so that what is sent is bounded; each lot
    is one more pass in the same tasks' plan. Null and empty texts hold nothing; null item ids are kept as they are;
    items without words are never met; equal rows get equal hits; without items all lists are empty. A text shorter than
    an item is compared as a whole. name replaces a column of that name.
    """
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]))

    def searched(lot) -> F.Column:
        sent = docs.sparkSession.sparkContext.broadcast(build_index(lot))

        @F.arrow_udf(HITS)
        def hits(texts: pa.Array) -> pa.Array:
            found = matches(texts.to_pylist(), sent.value)
            by_id = lambda x: (x[0] is not None, x[0] or 0)
            return pa.array([[{"item_id": k, "similarity": s, "first_word": at} for k, (s, at) in sorted(x.items(), key=by_id)] for x in found], kind)

        return hits(F.col(text))

    lots, lot = [], []
    for r in items.select(F.col(item_key).cast("long"), item_text).toLocalIterator():
        lot.append((r[0], r[1]))
        if len(lot) == ITEMS_AT_ONCE:
            lots.append(searched(lot))
            lot = []
    lots += [searched(lot)] if lot else []
    return docs.withColumn(name, F.concat(*lots) if lots else F.array().cast(HITS))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    return find_leaks(packed(docs, text), items, f"row_{text}").where(F.size("hits") == 0).select("row.*")


def op2_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item in it."""
    found = find_leaks(docs.select("doc_id", "text"), items, name="_hits")
    hit = F.explode("_hits").alias("h")
    return found.select("doc_id", hit).select("doc_id", "h.item_id", F.round("h.similarity", 9).alias("similarity"), "h.first_word")
