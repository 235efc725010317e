"""Edit-aware token counts: a tree of pre-token sums per document; an edit re-encodes only what it touches."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recent import Recent

LEAF, KNOWN = 64, 300_000
#: Texts are cut together, in lots of about so many pre-tokens.
LOT = 100_000
#: Pre-tokens before an edit that are cut again: a pre-token's end looks at most one character ahead, so two hold.
CONTEXT = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Token counts of pre-tokens. Merges never cross pre-tokens, so a text's count is the sum over its pre-tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.counts = Recent(lambda new: list(map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))), KNOWN).many


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class CountTree:
    """Pre-token lengths and token counts of one text: leaves of LEAF pre-tokens under a binary tree of sums."""

    def __init__(self, text: str, pieces: Pieces, cut: list[str] | None = None, counts: list[int] | None = None):
        self.pieces, self.text, self.encoded = pieces, text, 0
        cut = pieces.pattern.findall(text) if cut is None else cut
        self.plant(list(map(len, cut)), pieces.counts(cut) if counts is None else counts)

    def plant(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        starts = np.arange(0, len(lengths), LEAF)
        if len(lengths):
            self.sums[self.size : self.size + len(starts)] = np.add.reduceat(np.array([lengths, counts], np.int64), starts, axis=1).T
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_pieces(self) -> int:
        return sum(len(x) for x, _ in self.leaves)

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """Leaf of a character offset (the last one for the end) and the leaf's own offset."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if offset - start >= self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.size, len(self.leaves) - 1), start

    def update(self, leaf: int) -> None:
        node = leaf + self.size
        self.sums[node] = [sum(x) for x in self.leaves[leaf]]
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace characters [start, stop). Cutting begins CONTEXT pre-tokens earlier and ends at the first old
        boundary behind the edit that is met again: the rest is cut as before."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        grown = len(insert) - (stop - start)
        new = self.text[:start] + insert + self.text[stop:]
        first, at = self.leaf_at(start)
        back = 0  # pre-tokens that begin before the edit and stand in earlier leaves
        inside = 0
        for n in self.leaves[first][0]:
            if at + inside >= start:
                break
            inside += n
            back += 1
        while back < CONTEXT + 1 and first > 0:
            first -= 1
            at -= sum(self.leaves[first][0])
            back += len(self.leaves[first][0])
        lengths, counts = self.leaves[first]
        keep, begin = 0, at
        while keep < len(lengths) and begin + lengths[keep] <= start and back > CONTEXT:
            begin += lengths[keep]
            keep += 1
            back -= 1
        last, old = first, begin  # old: the old boundary at hand, the piece (last, k) begins there
        k, made, position = keep, [], begin
        while True:
            while old < stop or old + grown < position:  # step over old pieces up to where cutting has come
                while last < len(self.leaves) and k >= len(self.leaves[last][0]):
                    last, k = last + 1, 0
                if last >= len(self.leaves):
                    break
                old += self.leaves[last][0][k]
                k += 1
            if position >= len(new) or old >= stop and old + grown == position and position >= start + len(insert):
                break
            m = self.pieces.pattern.match(new, position)
            made.append(m[0])
            position = m.end()
        if position >= len(new):
            last, k = len(self.leaves) - 1, len(self.leaves[-1][0])
        tail = self.leaves[last] if last < len(self.leaves) else ([], [])
        self.encoded += len(made)
        fresh = (lengths[:keep] + list(map(len, made)) + tail[0][k:], counts[:keep] + self.pieces.counts(made) + tail[1][k:])
        self.text = new
        last = min(last, len(self.leaves) - 1)
        self.leaves[first] = fresh
        for i in range(first + 1, last + 1):
            self.leaves[i] = ([], [])
        if len(fresh[0]) > 4 * LEAF:
            self.plant([n for x, _ in self.leaves for n in x], [n for _, x in self.leaves for n in x])
        else:
            for i in range(first, last + 1):
                self.update(i)


RESULT = "struct<n_tokens:long,n_tokens_after:long,n_pieces:long,n_encoded:long,n_edits:long,n_chars_after:long>"


def trees(texts: list[str | None], pieces: Pieces) -> Iterator[CountTree]:
    """The tree of each text; pre-tokens of several texts are looked up together."""
    held, lot = [], []

    def grown() -> Iterator[CountTree]:
        counts, at = pieces.counts(lot), 0
        for text, n in held:
            yield CountTree(text, pieces, lot[at : at + n], counts[at : at + n])
            at += n

    for text in texts:
        cut = pieces.pattern.findall(text or "")
        held.append((text or "", len(cut)))
        lot += cut
        if len(lot) >= LOT:
            yield from grown()
            held, lot = [], []
    yield from grown()


def counted(tree: CountTree, edits: list[dict] | None) -> dict:
    out = {"n_tokens": tree.tokens, "n_pieces": tree.n_pieces, "n_edits": 0}
    for e in edits or []:
        if e is not None:
            tree.edit(e["start"] or 0, e["stop"] or 0, e["insert"] or "")
            out["n_edits"] += 1
    return out | {"n_tokens_after": tree.tokens, "n_encoded": tree.encoded, "n_chars_after": len(tree.text)}


def count_tokens(docs: DataFrame, text: str = "text", edits: str = "edits", name: str = "counts", path: str | None = None) -> DataFrame:
    """Adds token counts of every whole text before and after its edits, a list of (start, stop, insert) in characters
    that apply in turn.

    Null texts are empty; null edits, or null in an edit, change nothing, 0 or nothing; ends beyond the text are moved to
    its end. n_encoded counts pre-tokens that edits encoded again. name replaces a column of that name.
    """
    path = path or default_tokenizer()
    kind = pa.struct([(f, pa.int64()) for f in ("n_tokens", "n_tokens_after", "n_pieces", "n_encoded", "n_edits", "n_chars_after")])

    @F.arrow_udf(RESULT)
    def result(texts: pa.Array, changes: pa.Array) -> pa.Array:
        pieces = pieces_of(path)
        return pa.array([counted(t, e) for t, e in zip(trees(texts.to_pylist(), pieces), changes.to_pylist(), strict=True)], kind)

    return docs.withColumn(name, result(F.col(text), F.col(edits)))


def revision_of(key: Column, text: Column) -> Column:
    """Edits made from a document itself: one replacement, one insertion and one deletion at hashed places; what is
    inserted is a passage of its own text."""
    size = F.coalesce(F.length(text), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(key, F.lit(k)), size + 1).cast("int")
    passage = lambda k: F.coalesce(F.substring(text, place(k), F.lit(24)), F.lit(""))
    edit = lambda start, cut, insert: F.struct(start.alias("start"), (start + cut).alias("stop"), insert.alias("insert"))
    return F.array(edit(place(1), F.lit(9), passage(2)), edit(place(3), F.lit(0), passage(4)), edit(place(5), F.lit(30), F.lit("")))


def op7_token_counts(docs: DataFrame) -> DataFrame:
    revised = docs.select("doc_id", "text", revision_of(F.col("doc_id"), F.col("text")).alias("edits"))
    return count_tokens(revised, name="_c").select("doc_id", "_c.*")
