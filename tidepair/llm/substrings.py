"""Removal of repeated byte strings by suffix arrays: two-stage sorting of what can repeat at all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parts
from .shingles import mixed, powers

#: Strings of SPAN bytes are looked for; an anchor is the least of the hashes of the GRAM-byte grams of such a string.
SPAN, GRAM = 200, 32
WIDTH = SPAN - GRAM + 1
#: String starts in a piece; bytes of pieces sorted together; pieces of one anchor beyond which their strings are compared
#: one by one, spread over the cluster.
PIECE, BLOCK_BYTES, CROWD = 2048, 1 << 20, 3000


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte grams of a byte string."""
    up, down = powers(1 << max(10, int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of every run of so many values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def anchor_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor: first start, number of starts, anchor; and the anchors that stand at
    two places or more. Equal strings have equal anchors wherever they are."""
    grams = gram_hashes(raw)
    least = sliding(grams, WIDTH, np.minimum)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    n = np.diff(np.append(first, len(least)))
    held = np.zeros(len(grams) + WIDTH - 1, np.uint64)
    held[WIDTH - 1 : WIDTH - 1 + len(least)] = least
    places = grams[grams == sliding(held, WIDTH, np.maximum)]  # grams that are the least of a string that holds them
    values, count = np.unique(places, return_counts=True)
    return first, n, least[first], values[count > 1]


def descending(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are greater than their successors. Symbol 0 ends a text and counts as smaller."""
    change = np.flatnonzero(np.concatenate((symbols[1:] != symbols[:-1], [True])))
    after = np.where(change + 1 < len(symbols), symbols[np.minimum(change + 1, len(symbols) - 1)].astype(int), -1)
    run = np.searchsorted(change, np.arange(len(symbols)))
    return (symbols > 0) & (after[run] < symbols)


def suffix_order(symbols: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of all texts in the order of their first SPAN symbols.

    symbols: texts of symbols above 0, each followed by a 0, and SPAN zeros at the end; begin: where each text begins;
    starts: how many leading suffixes of each text are wanted.
    Stage one sorts only the suffixes that are smaller than their successors, by comparing them. Stage two goes through
    the buckets of first symbols in ascending order: each suffix found puts its predecessor, if that is greater than it,
    at the end of the greater ones of its own bucket, which come before the smaller ones there. A wanted suffix hangs on
    the next one that is smaller than its successor, so sorting goes on to that one behind the last wanted start.
    """
    greater = descending(symbols)
    direct = np.flatnonzero(~greater)
    last = direct[np.searchsorted(direct, begin + starts - 1)]  # of each text; its closing 0 at the latest
    edge = np.zeros(len(symbols) + 1, np.int64)
    edge[begin] += 1
    np.subtract.at(edge, last + 1, 1)
    used = np.cumsum(edge[:-1]) > 0
    opening = np.zeros(len(symbols), bool)
    opening[begin] = True
    direct = direct[used[direct]]
    rows = np.lib.stride_tricks.sliding_window_view(symbols, SPAN)[direct]
    beyond = np.flatnonzero((rows == 0).any(axis=1))
    if len(beyond):  # what follows a text's end is no part of it
        rows[beyond] = np.where(np.logical_or.accumulate(rows[beyond] == 0, axis=1), 0, rows[beyond])
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{SPAN}").ravel(), kind="stable")]
    head = symbols[direct]
    cuts = np.searchsorted(head, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.unique(symbols[used]).tolist():
        bucket = [np.concatenate(waiting[c])] if waiting[c] else []
        while bucket and len(bucket[-1]):  # runs of c itself
            before = bucket[-1][~opening[bucket[-1]]] - 1
            bucket.append(before[symbols[before] == c])
        found = np.concatenate([*bucket, direct[cuts[c] : cuts[c + 1]]])
        waiting[c] = []
        out.append(found)
        before = found[~opening[found]] - 1
        before = before[symbols[before] > c]
        if not len(before):
            continue
        kind = symbols[before]
        order = np.argsort(kind, kind="stable")
        values, at = np.unique(kind[order], return_index=True)
        for d, group in zip(values.tolist(), np.split(before[order], at[1:]), strict=True):
            waiting[d].append(group)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it, up to SPAN; 0 for the first."""
    windows, out = np.lib.stride_tricks.sliding_window_view(symbols, SPAN), np.zeros(len(order), np.int64)
    for at in range(1, len(order), 20_000):
        k = np.arange(at, min(at + 20_000, len(order)))
        differ = windows[order[k]] != windows[order[k - 1]]
        out[k] = np.where(differ.any(axis=1), differ.argmax(axis=1), SPAN)
    return out


def repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """Per piece, which of its strings of SPAN bytes (by start) stand at another place of the pieces too."""
    size = np.array([len(p) for p in pieces])
    begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    symbols = np.frombuffer(b"\xff".join(pieces) + b"\xff" * (SPAN + 1), np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255
    starts = size - SPAN + 1
    order = suffix_order(symbols, begin, starts)
    wanted = np.zeros(len(symbols), bool)
    for b, n in zip(begin.tolist(), starts.tolist(), strict=True):
        wanted[b : b + n] = True
    order = order[wanted[order]]
    same = common_prefixes(symbols, order) >= SPAN
    again = np.zeros(len(symbols), bool)
    again[order[same | np.append(same[1:], False)]] = True
    return [again[b : b + n] for b, n in zip(begin.tolist(), starts.tolist(), strict=True)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true flags as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def squeezed(texts: pa.Array) -> pa.Array:
    import zstandard as zs

    press = zs.ZstdCompressor(1)
    return pa.array([None if not t.is_valid else press.compress(t.as_py()) for t in texts], pa.binary())


def expanded(data: pa.Array) -> Iterator[bytes]:
    import zstandard as zs

    press = zs.ZstdDecompressor()
    return (press.decompress(d.as_py()) for d in data)


def anchors(texts: pa.Array) -> pa.Array:
    """Distinct anchors of texts, and whether each stands twice in its text."""
    out = []
    for t in texts:
        raw = np.frombuffer(t.as_py() or b"", np.uint8)
        found, twice = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if len(raw) >= SPAN:
            _, _, found, twice = anchor_runs(raw)
        found = np.unique(found)
        out.append([{"anchor": a, "twice": s} for a, s in zip(found.view(np.int64).tolist(), np.isin(found, twice).tolist(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("anchor", pa.int64()), ("twice", pa.bool_())])))


def pieces_of(data: pa.Array, wanted: pa.Array) -> pa.Array:
    """Pieces of texts around the wanted anchors: first start, number of starts, anchor, bytes and a key of the bytes."""
    out = []
    for raw, anchors_ in zip(expanded(data), wanted, strict=True):
        first, n, anchor, _ = anchor_runs(np.frombuffer(raw, np.uint8))
        rows = []
        for i in np.flatnonzero(np.isin(anchor, np.array(anchors_.as_py(), np.int64).view(np.uint64))).tolist():
            for at in range(0, int(n[i]), PIECE):
                start, k = int(first[i]) + at, min(PIECE, int(n[i]) - at)
                piece = raw[start : start + k + SPAN - 1]
                rows.append({"start": start, "n": k, "anchor": int(anchor[i : i + 1].view(np.int64)[0]), "piece": piece, "piece_key": hashlib.blake2b(piece, digest_size=16).digest()})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("piece", pa.binary()), ("piece_key", pa.binary())])))


def strings_of(pieces: pa.Array) -> pa.Array:
    """128-bit hashes of the strings of pieces, by start."""
    out = []
    for p in pieces:
        raw = p.as_py()
        out.append([hashlib.blake2b(raw[i : i + SPAN], digest_size=16).digest() for i in range(len(raw) - SPAN + 1)])
    return pa.array(out, pa.list_(pa.binary()))


RUNS = "array<struct<first:long,end:long>>"
RUN_KIND = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def as_runs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"first": a, "end": b} for a, b in runs]


def sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, piece, piece_key, copies) in the order of anchor -> (piece_key, runs of repeated starts). A block
    holds whole anchors; with CROWD it is bounded."""
    names, kind = ["piece_key", "runs"], pa.binary()

    def found(keys, pieces, copies) -> pa.RecordBatch:
        rows = []
        for key, again, n in zip(keys, repeated_starts(pieces), copies, strict=True):
            runs = [(0, len(again))] if n > 1 else runs_of(again)
            if runs:
                rows.append((key, as_runs(runs)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], RUN_KIND)], names)

    keys, pieces, copies, held, last = [], [], [], 0, None
    for batch in batches:
        for anchor, piece, key, n in zip(*(batch.column(i) for i in range(4)), strict=True):
            if anchor != last and held >= BLOCK_BYTES:
                yield found(keys, pieces, copies)
                keys, pieces, copies, held = [], [], [], 0
            last = anchor
            keys.append(key.as_py())
            pieces.append(piece.as_py())
            copies.append(n.as_py())
            held += len(pieces[-1])
    if keys:
        yield found(keys, pieces, copies)


def cleaned(data: pa.Array, spans: pa.Array, copies: pa.Array) -> pa.Array:
    """What is left of texts without the bytes of their repeated strings."""
    kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    out = []
    for raw, starts, n in zip(expanded(data), spans, copies, strict=True):
        cover = np.zeros(len(raw) + 1, np.int32)
        for s in [{"first": 0, "end": len(raw) - SPAN + 1}] if n.as_py() > 1 else starts.as_py() or []:
            cover[s["first"]] += 1
            cover[s["end"] + SPAN - 1] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append({"n_removed": int(gone.sum()), "n_spans": len(runs_of(gone)), "kept": kept})
    return pa.array(out, kind)


def text_key(text: Column) -> list[Column]:
    """128 bits of a text's md5 as two numbers."""
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return [half(1).alias("a"), half(17).alias("b")]


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per distinct text of SPAN bytes or more from which something goes: (a, b, n_removed, n_spans, kept).

    A byte goes if a string of SPAN bytes that covers it starts anywhere else too; (a, b) is text_key of the text. Steps:
    1. A string has an anchor that depends on its bytes alone, so strings can only repeat where an anchor stands at two
       places of the corpus: anchors are counted, and only pieces around repeated anchors go on.
    2. Equal pieces become one with a count. Pieces of an anchor meet in one block, and two-stage suffix sorting and
       common prefixes of neighbours find the repeated strings in it. Anchors with over CROWD pieces are no block: each of
       their strings is counted by its hash.
    3. Runs of starts go back to the texts. Copies of a text are one text with a count, removed as a whole.
    Texts travel compressed. Null and short texts have no such string; repeated rows are copies; an empty table gives no
    rows. 64-bit anchors only select; texts, pieces and crowded strings are told apart by 128-bit hashes.
    """
    long_ = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= SPAN)
    keyed = long_.select(*text_key(F.col("text")), F.col("text").cast("binary").alias("raw"))
    kind = "array<struct<anchor:long,twice:boolean>>"
    seen = keyed.select("a", "b", F.explode(F.arrow_udf(anchors, kind)("raw")).alias("x")).select("a", "b", "x.*")
    repeated = seen.groupBy("anchor").agg(F.min("a").alias("least"), F.max("a").alias("most"), F.max("twice").alias("twice"))
    repeated = repeated.where(F.col("twice") | (F.col("least") != F.col("most"))).select("anchor")
    wanted = seen.join(repeated, "anchor", "left_semi").groupBy("a", "b").agg(F.collect_set("anchor").alias("wanted"))
    packed = keyed.select("a", "b", F.arrow_udf(squeezed, "binary")("raw").alias("data"))
    distinct = packed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"))

    kind = "array<struct<start:long,n:long,anchor:long,piece:binary,piece_key:binary>>"
    piece = F.explode(F.arrow_udf(pieces_of, kind)("data", "wanted")).alias("p")
    found = cut(distinct.join(wanted, ["a", "b"]).select("a", "b", "copies", piece).select("a", "b", "copies", "p.*"))
    crowded = found.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor")
    pieces = found.groupBy("anchor", "piece", "piece_key").agg(F.sum("copies").alias("copies"))
    blocks = pieces.join(crowded, "anchor", "left_anti").repartition(parts(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    sorted_ = blocks.select("anchor", "piece", "piece_key", "copies").mapInArrow(sorted_blocks, f"piece_key binary, runs {RUNS}")
    crowd = pieces.join(crowded, "anchor", "left_semi")
    each = crowd.select("piece_key", "copies", F.posexplode(F.arrow_udf(strings_of, "array<binary>")("piece")).alias("at", "string"))
    often = each.groupBy("string").agg(F.sum("copies").alias("n")).where("n > 1").select("string")
    single = F.array(F.struct(F.col("at").cast("long").alias("first"), (F.col("at") + 1).cast("long").alias("end")))
    runs = sorted_.union(each.join(often, "string").select("piece_key", single))
    runs = cut(runs.groupBy("piece_key").agg(F.flatten(F.collect_list("runs")).alias("runs")))

    places = found.select("a", "b", "start", "piece_key").join(runs, "piece_key").select("a", "b", "start", F.explode("runs").alias("r"))
    spans = places.groupBy("a", "b").agg(F.collect_list(F.struct((F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.end")).alias("end"))).alias("spans"))
    affected = distinct.join(spans, ["a", "b"], "left").where("copies > 1 OR spans IS NOT NULL")
    result = F.arrow_udf(cleaned, "struct<n_removed:long,n_spans:long,kept:binary>")("data", "spans", "copies")
    return affected.select("a", "b", result.alias("x")).select("a", "b", "x.*")


def op3_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    gone = remove_repeats(docs).select("a", "b", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", *text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    out = own.join(gone, ["a", "b"], "left")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
