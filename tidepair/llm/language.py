"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the model: labelled texts sampled per language, their length, symbols learned per language.
SAMPLE_TEXTS, SAMPLE_LENGTHS, LEARN_SYMBOLS, ALPHABET = 96, (100, 4000), 32768, 120
#: Symbols: padding, a run of characters that are not letters, a letter never learned; then the learned letters.
PAD, GAP, STRANGE, FIRST = 0, 1, 2, 3
CHUNK, SLICE = 256, 1 << 20


@functools.cache
def letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 where it is no letter."""
    lower = lambda c: ord(c.lower()[0])
    return np.array([lower(chr(i)) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


@dataclass
class Model:
    langs: list[str]
    symbols: np.ndarray  # symbol of each code point
    width: int
    tables: list[np.ndarray]  # per language: next state of (state, symbol), negative (-1 - state) if a phrase begins there
    sizes: list[int]


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    s = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    return s[(s != GAP) | (np.concatenate(([0], s[:-1])) != GAP)] if len(s) else s


def suffix_automaton(sequence: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton as rows of states; -1 where there is none. Time and states in proportion."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for a in sequence:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and a not in nxt[p]:
            nxt[p][a] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][a]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(a) == q:
                    nxt[p][a] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    out = np.full((len(nxt), width), -1, np.int32)
    for i, row in enumerate(nxt):
        for a, j in row.items():
            out[i, a] = j
    return out


def parsing_table(automaton: np.ndarray) -> np.ndarray:
    """Where no transition goes on, the symbol begins a phrase from the root; so it does at the root itself, where one is
    also after a symbol that the language never had."""
    root = np.maximum(automaton[0], 0)
    out = np.where(automaton >= 0, automaton, -1 - root[None, :]).astype(np.int32)
    out[0] = -1 - root
    out[:, PAD] = 0
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of labelled texts; languages in code point order, texts in the given order up to LEARN_SYMBOLS."""
    lower, count = letters(), {}
    for texts in samples.values():
        for t in texts:
            for c, n in zip(*np.unique(lower[np.frombuffer(t.encode("utf-32-le"), np.uint32)], return_counts=True), strict=True):
                count[int(c)] = count.get(int(c), 0) + int(n)
    count.pop(0, None)
    alphabet = sorted(sorted(count, key=lambda c: (-count[c], c))[:ALPHABET])
    of = np.full(0x110000, STRANGE, np.uint8)
    of[0] = GAP
    of[alphabet] = np.arange(FIRST, FIRST + len(alphabet))
    table, width = of[lower], FIRST + len(alphabet)
    langs, tables, sizes = sorted(samples), [], []
    for lang in langs:
        learned: list[int] = []
        for t in samples[lang]:
            if len(learned) < LEARN_SYMBOLS:
                learned += [*symbols_of(t, table).tolist()[: LEARN_SYMBOLS - len(learned)], width]  # texts end in a symbol of their own
        tables.append(parsing_table(suffix_automaton(learned, width + 1)[:, :width]))
        sizes.append(max(2, len(learned)))
    return Model(langs, table, width, tables, sizes)


def phrases(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Phrases (sequence, language) of symbol sequences. Sequences are parsed in chunks of CHUNK symbols side by side,
    each begun anew."""
    per = np.array([-(-len(s) // CHUNK) for s in sequences])
    grid = np.zeros((int(per.sum()), CHUNK), np.uint8)
    row = 0
    for s, k in zip(sequences, per, strict=True):
        grid[row : row + k].reshape(-1)[: len(s)] = s
        row += k
    steps = np.ascontiguousarray(grid.T).astype(np.int64)
    out = np.zeros((len(sequences), len(model.langs)))
    owner = np.repeat(np.arange(len(sequences)), per)
    for j, table in enumerate(model.tables):
        flat, state, begun = table.ravel(), np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)
        for column in steps:
            state = flat[state * model.width + column].astype(np.int64)
            new = state < 0
            begun += new
            state ^= -new.astype(np.int64)  # -1 - state where a phrase begins
        np.add.at(out[:, j], owner, begun)
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of texts. The score is the runner-up's share of phrases: 0.5 is a tie, towards 1 is clear."""
    total, length, known = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts)), np.zeros(len(texts), bool)
    held, held_size = [], 0

    def flush():
        nonlocal held, held_size
        if held:
            np.add.at(total, [i for i, _ in held], phrases(model, [s for _, s in held]))
        held, held_size = [], 0

    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), SLICE):
            s = symbols_of(t[at : at + SLICE], model.symbols)
            known[i] |= bool((s > GAP).any())
            length[i] += len(s)
            held.append((i, s))
            held_size += len(s)
            if held_size >= SLICE:
                flush()
    flush()
    bits = total * np.log2(np.array(model.sizes or [2]))[None, :] / np.maximum(length, 1)[:, None] if model.langs else total
    langs, scores = [], []
    for i in range(len(texts)):
        if not known[i] or not model.langs:
            langs.append("und")
            scores.append(0.0)
            continue
        order = np.argsort(bits[i], kind="stable")
        second = bits[i, order[1]] if len(order) > 1 else math.inf
        langs.append(model.langs[order[0]])
        scores.append(1.0 if second == math.inf else float(second / (bits[i, order[0]] + second)))
    return langs, scores


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, list[str]]:
    """About SAMPLE_TEXTS labelled texts per language, by hash, of SAMPLE_LENGTHS characters (any length where a language
    has none of those), never held-out ones: what a model is fitted on is bounded, whatever the corpus."""
    fits = F.length(text).between(*SAMPLE_LENGTHS)
    pool = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.length(text) > 0) & ~held_out(F.col(key))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), fits.alias("fits"), F.xxhash64(key, text).alias("turn"))
    counts = {r["lang"]: (r["fit"], r["n"]) for r in pool.groupBy("lang").agg(F.sum(F.col("fits").cast("long")).alias("fit"), F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    wanted = F.lit(False)
    for name, (fit_, n) in counts.items():
        wanted |= (F.col("lang") == name) & (F.col("fits") | F.lit(not fit_)) & (F.pmod("turn", F.lit(max(1, fit_ or n))) < SAMPLE_TEXTS)
    rows = pool.where(wanted).select("lang", F.substring("text", 1, LEARN_SYMBOLS).alias("text"), "turn").collect()
    out: dict[str, list[str]] = {name: [] for name in counts}
    for r in sorted(rows, key=lambda r: (r["turn"], r["text"])):
        out[r["lang"]].append(r["text"])
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """Adds struct (lang, score) of every whole text: und and 0 for null, empty and letterless texts. The model is
    bounded by its sample and is sent to the tasks once. name replaces a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = predict(sent.value, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return docs.withColumn(name, predicted(F.col(text)))


def op4_language_id(docs: DataFrame) -> DataFrame:
    model = fit(training_sample(docs.select("doc_id", "text", "lang")))
    found = identify(docs.select("doc_id", "text"), model, name="_l")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))
