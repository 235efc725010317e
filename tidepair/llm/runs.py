"""Periodic runs of words: an online sparse dynamic program over diagonals (lags) of equal words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ready

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3

KIND = pa.struct([("runs", pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
                  ("n_words", pa.int64()), ("collapsed", pa.string())])
RESULT = "struct<runs:array<struct<start:long,length:long,period:long>>,n_words:long,collapsed:string>"


def occurrences(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (ascending within a key) whose key stands elsewhere too, a number for each key, and the nearest earlier
    place with the same key (-1 for the first)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    again = np.concatenate(([False], same)) if len(k) else np.zeros(0, bool)
    twice = again | np.concatenate((again[1:], [False])) if len(k) else again
    place = at[order]
    before = np.where(again, np.concatenate(([-1], place[:-1])), -1) if len(k) else place
    return place[twice], np.cumsum(~again)[twice], before[twice]


def diagonals(place: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active lags along the words: one longer than at the word before if that one met its earlier occurrence at the same
    lag, else begun anew. Returns where each ended diagonal began, its length and its lag."""
    order = np.argsort(place)
    place, lag = place[order], lag[order]
    new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1])))
    first = np.flatnonzero(new)
    return place[first], np.diff(np.append(first, len(place))), lag[first]


def runs_of(words: np.ndarray, begin: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """Runs (text, start, length, period) of word numbers in texts one after the other; text i begins at begin[i].

    Earlier occurrences are those of a word in its context of the `size` words from it on, and only the nearest one is
    looked at. That loses nothing: for a run of period q and context sizes from q on, the nearest earlier occurrence
    within the run stands exactly q before (a nearer one would make the period shorter), and a run of at least `times`
    periods holds a whole context of fewer than 2 q words at that lag. So contexts of size s answer for lags in
    (s / 2, s], the smallest size for all lags up to it, and the work is n log n on any text. Contexts are named exactly,
    each size by pairs of names of half the size; places whose context stands nowhere else leave.
    """
    n_texts = len(begin) - 1
    text = np.repeat(np.arange(n_texts), np.diff(begin))
    at = np.arange(len(words)) + text  # one empty place behind each text: no context crosses it
    size, smallest = 1, 1
    while 2 * smallest <= least * (times - 1) // times:
        smallest *= 2
    place, name, before = occurrences(at, text * (int(words.max(initial=0)) + 1) + words)
    found = []
    named = np.full(len(words) + n_texts, -1, np.int64)
    while len(place):
        if size >= smallest:
            lag = place - before
            active = (before >= 0) & (lag > (0 if size == smallest else size // 2)) & (lag <= size)
            if active.any():
                where, count, period = diagonals(place[active], lag[active])
                length = count + size - 1 + period
                enough = length >= np.maximum(least, times * period)
                found.append(np.stack((where - period, length, period))[:, enough])
        named[:] = -1
        named[place] = name
        inside = place + size < len(named)
        place, name = place[inside], name[inside]
        other = named[place + size]
        whole = other >= 0
        place, before_key = place[whole], name[whole] * (int(name.max(initial=0)) + 1) + other[whole]
        place, name, before = occurrences(place, before_key)
        size *= 2
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    first_place = begin[:-1] + np.arange(n_texts)
    owner = np.searchsorted(first_place, start, "right") - 1
    start = start - first_place[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def searched(texts: pa.Array, least: int, times: int) -> pa.Array:
    """Runs, number of words and collapsed text of each text."""
    trimmed = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    lists = pc.ascii_split_whitespace(trimmed)
    lengths = np.where(np.asarray(pc.equal(trimmed, "")), 0, np.asarray(pc.list_value_length(lists)))
    words = lists.flatten()
    words = words.filter(pc.not_equal(words, ""))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    numbers = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, start, length, period = runs_of(numbers, begin, least, times)
    change = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(change, begin[owner] + start + period, 1)
    np.add.at(change, begin[owner] + start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = np.concatenate(([0], np.cumsum(keep)))[begin]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(keep))), " ")
    each = np.searchsorted(owner, np.arange(len(lengths) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(each), runs), pa.array(lengths, pa.int64()), collapsed], fields=list(KIND))


def find_runs(docs: DataFrame, text: str = "text", name: str = "found", least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """Adds a struct column: runs (start, length, period in words; by start, then period), n_words, and the collapsed
    text (the words that stand in no run behind its first period, joined by one space).

    A run is a stretch of words with smallest period q, at least `least` words and `times` q long, that no neighbouring
    word extends. Null and empty texts have no words and no runs; repeated rows get equal results; an empty table stays
    empty; a column of the new name is replaced, all others stay. A text is searched as a whole in one task, in memory of
    some 150 bytes a word and time n log n, however repetitive it is.
    """
    if times < 3:
        raise ValueError("a run needs at least three periods")
    ready(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def result(texts: pa.Array) -> pa.Array:
        return searched(texts, least, times)

    return docs.withColumn(name, result(F.col(text)))


def looped(text: Column, hash_: Column) -> Column:
    """Texts with a planted loop where the hash ends in 0: from some word on, the words there repeat with some period."""

    def planted(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        import re

        out, words = texts.to_pylist(), re.compile(WORD)
        for i, h in enumerate(hashes.to_pylist()):
            w = words.findall(out[i] or "") if h is not None and h % 10 == 0 else []
            if w:
                g = h // 10
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                out[i] = " ".join(w[:a] + [w[a + k % p] for k in range(len(w) - a)])
        return pa.array(out, pa.string())

    return F.arrow_udf(planted, "string")(text, hash_)


def longest_repeat(runs: Column) -> Column:
    """The run of greatest length/period; the first one of ties, null without runs."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def op11_periodic_runs(docs: DataFrame) -> DataFrame:
    """Contract of op11. A null doc_id has no hash, so its text gets no loop."""
    ready(docs.sparkSession)
    rows = docs.select("doc_id", looped(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text"))
    rows = find_runs(rows).select("doc_id", "found", longest_repeat(F.col("found.runs")).alias("best"))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    listed = F.array_join(F.transform("found.runs", lambda x: F.concat(line(x), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("found.collapsed"), 256).alias("collapsed_sha256"))
