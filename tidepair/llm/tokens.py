"""Token-id output: documents compressed one by one under a shared zstandard dictionary, in blocks with an offset index.

A token table is a folder of Parquet tables that Spark writes and reads, so it works in any store and survives lost
executors:
  dictionary  dict_hash, data                      one row
  blocks      dict_hash, width, shard, block, first_id, last_id, doc_ids, offsets, n_tokens, data
A block holds the frames of consecutive documents in data; frame i of a block is data[offsets[i]:offsets[i + 1]], the
token ids of a document as little-endian unsigned integers of width bytes. first_id and last_id let a reader of a few
documents skip blocks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, shared_folder
from .recent import Recent

END_ID = 1
#: Bounds of the dictionary's sample: documents and their characters; its size; level; bytes of a block before it is closed.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL, BLOCK_BYTES = 2000, 8000, 65536, 3, 1 << 20
#: Stems remembered, characters of texts looked up at once, new stems encoded at once, and marks that may follow a stem.
KNOWN_STEMS, LOT_CHARS, RUN, MARKS = 150_000, 1 << 20, 500, ".,!?;:"
#: A stem's last letter that marks may be told from.
LETTER = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]\z"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The spans of values from some starts, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit integers of byte strings one after the other, where each begins, and how many it has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes, sizes


class Words:
    """Ids of a tokenizer by chunk of text between spaces and line feeds.

    This tokenizer drops white space and splits letters from marks before it merges, so no token spans a chunk's end, or
    a Latin-1 letter (others may fold to a letter and a mark) and the sentence marks after it; it lower-cases, so A-Z of
    an ASCII chunk can be lower-cased before. The distinct chunks of a lot of texts are told apart by Arrow; their stems
    are remembered within a bound.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer, self.letters.pre_tokenizer = None, WhitespaceSplit()  # the same for words of a-z alone
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)  # ids that close a pre-token
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.stems = Recent(self.fresh, KNOWN_STEMS)

    def fresh(self, stems: list[str]) -> list[bytes]:
        """Ids of new stems, as bytes of 32-bit integers. Runs of letters are one pre-token each: RUN of them are encoded
        as one text and told apart by the ids that close a pre-token; should their number not fit, they are encoded one
        by one like all others."""
        plain, out = [s for s in stems if s.isalpha()], {}
        simple = [s for s in plain if s.isascii() and s.islower()]
        other = [s for s in plain if not (s.isascii() and s.islower())]
        for tokenizer, some in ((self.letters, simple), (self.tokenizer, other)):
            runs = [some[i : i + RUN] for i in range(0, len(some), RUN)]
            for run, e in zip(runs, tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(run) and ends[-1] == len(ids):
                    at, data = [0, *(4 * ends).tolist()], ids.tobytes()
                    out.update((s, data[a:b]) for s, a, b in zip(run, at[:-1], at[1:], strict=True))
        rest = [s for s in stems if s not in out]
        for i in range(0, len(rest), RUN):
            found = self.tokenizer.encode_batch_fast(rest[i : i + RUN], add_special_tokens=False)
            out.update((s, array("I", e.ids).tobytes()) for s, e in zip(rest[i : i + RUN], found, strict=True))
        return [out[s] for s in stems]

    def chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks: those of the stem, then those of the marks behind it."""
        bare = pc.utf8_rtrim(chunks, MARKS)
        bare = pc.if_else(pc.match_substring_regex(bare, LETTER), bare, chunks)
        cut = pc.binary_length(bare)
        stems = pc.if_else(pc.and_not(pc.string_is_ascii(bare), pc.match_substring(bare, "|")), pc.ascii_lower(bare), bare).dictionary_encode()
        marked = np.flatnonzero(np.asarray(pc.not_equal(cut, pc.binary_length(chunks))))
        places = pa.array(marked)
        marks = [c[n:].decode() for c, n in zip(chunks.take(places).cast(pa.binary()).to_pylist(), cut.take(places).to_pylist(), strict=True)]
        distinct = sorted(set(marks))
        values, starts, sizes = flat(self.stems.many(stems.dictionary.to_pylist()) + self.fresh(distinct) + [b""])
        of_mark = {m: len(stems.dictionary) + i for i, m in enumerate(distinct)}
        parts = np.full((len(chunks), 2), len(sizes) - 1)
        parts[:, 0] = stems.indices
        parts[marked, 1] = [of_mark[m] for m in marks]
        both = sizes[parts]
        joined, size = gathered(values, starts[parts].ravel(), both.ravel()), both.sum(axis=1)
        return joined, np.cumsum(size) - size, size

    def encode(self, texts: Iterable[str | None], end_id: int = END_ID) -> Iterator[np.ndarray]:
        """Ids of texts, each with the end id; texts are looked up together, in lots of about LOT_CHARS characters."""
        end = np.array([end_id], "<u4")

        def found(lot: list[str]) -> Iterator[np.ndarray]:
            chunks = pc.split_pattern(pc.replace_substring(pa.array(lot, pa.string()), "\n", " "), " ")
            places = np.asarray(chunks.offsets)
            coded = chunks.values.dictionary_encode()
            values, starts, sizes = self.chunk_ids(coded.dictionary)
            which = np.asarray(coded.indices)
            for a, b in zip(places[:-1], places[1:], strict=True):
                yield np.append(gathered(values, starts[which[a:b]], sizes[which[a:b]]), end)

        lot, held = [], 0
        for t in texts:
            lot.append(t or "")
            held += len(lot[-1])
            if held >= LOT_CHARS:
                yield from found(lot)
                lot, held = [], 0
        yield from found(lot)


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


def train_dictionary(samples: list[bytes]):
    """A zstandard dictionary; from few samples it is their bytes themselves, from none there is none."""
    import zstandard as zs

    try:
        return zs.train_dictionary(DICT_BYTES, samples)
    except zs.ZstdError:
        return zs.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], zs.DICT_TYPE_RAWCONTENT) if any(samples) else None


def as_dictionary(data: bytes):
    import zstandard as zs

    return zs.ZstdCompressionDict(data) if data else None


def fitted_dictionary(docs: DataFrame, text: str, key: str, path: str) -> bytes:
    """Trained on about SAMPLE_DOCS whole documents of up to SAMPLE_CHARS characters, chosen by hash."""

    @F.arrow_udf("binary")
    def serialized(texts: pa.Array) -> pa.Array:
        words = words_of(path)
        return pa.array([ids.astype(f"<u{words.width}").tobytes() for ids in words.encode(t.as_py() for t in texts)], pa.binary())

    short = docs.where(F.length(text) <= SAMPLE_CHARS)
    n = short.count()
    chosen = short.where(F.pmod(F.xxhash64(key, text), F.lit(max(n, 1))) < SAMPLE_DOCS)
    samples = sorted(bytes(r[0]) for r in chosen.select(serialized(text)).collect())
    found = train_dictionary(samples)
    return found.as_bytes() if found else b""


BLOCKS = ("dict_hash string, width int, shard int, block int, first_id long, last_id long, doc_ids array<long>, "
          "offsets array<long>, n_tokens array<long>, data binary")


def block_schema() -> pa.Schema:
    i, n = pa.int32(), pa.int64()
    return pa.schema([("dict_hash", pa.string()), ("width", i), ("shard", i), ("block", i), ("first_id", n), ("last_id", n),
                      ("doc_ids", pa.list_(n)), ("offsets", pa.list_(n)), ("n_tokens", pa.list_(n)), ("data", pa.binary())])


def write_tokens(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", path: str | None = None, end_id: int = END_ID) -> None:
    """Write a token table of every whole text, in ascending order of key (nulls first, then by text).

    Null and empty texts are their end id alone; repeated rows are written as often as they come; an empty table gives
    a table without blocks. Documents are dealt by ranges of key, encoded and packed as a stream: a task holds one block
    and one document.
    """
    path = path or default_tokenizer()
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    spark, trained = docs.sparkSession, fitted_dictionary(docs, "text", "key", path)
    digest = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(digest, trained)], "dict_hash string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    sent = spark.sparkContext.broadcast(trained)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zs
        from pyspark import TaskContext

        words, shard, block = words_of(path), TaskContext.get().partitionId(), 0
        squeeze = zs.ZstdCompressor(LEVEL, dict_data=as_dictionary(sent.value))
        ids, counts, offsets, frames = [], [], [0], []

        def closed() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [digest, words.width, shard, block, min(known, default=None), max(known, default=None), ids, offsets, counts, b"".join(frames)]
            return pa.RecordBatch.from_pylist([dict(zip(block_schema().names, row, strict=True))], block_schema())

        for batch in batches:
            for k, found in zip(batch.column(0), words.encode((t.as_py() for t in batch.column(1)), end_id), strict=True):
                frame = squeeze.compress(found.astype(f"<u{words.width}").tobytes())
                ids.append(k.as_py())
                counts.append(len(found))
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                if offsets[-1] >= BLOCK_BYTES:
                    yield closed()
                    block += 1
                    ids, counts, offsets, frames = [], [], [0], []
        if ids:
            yield closed()

    dealt = docs.repartitionByRange(parts(spark), "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Documents of a token table: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids.

    The dictionary is checked against the hash that every block carries. Starts come from totals of shards, totals of
    the blocks of a shard, and running sums inside blocks.
    """
    digest, trained = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(trained).hexdigest() != digest:
        raise ValueError("the dictionary doesn't fit its hash")
    sent = spark.sparkContext.broadcast(bytes(trained))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")

    @F.arrow_udf("array<struct<doc_id:long,inside:long,n_tokens:long,ids_crc32:long,ids:array<long>>>")
    def unpacked(hashes: pa.Array, widths: pa.Array, doc_ids: pa.Array, offsets: pa.Array, data: pa.Array) -> pa.Array:
        import zstandard as zs

        expand = zs.ZstdDecompressor(dict_data=as_dictionary(sent.value))
        sums, sizes, inside, lists = array("q"), array("q"), array("q"), []
        for h, width, names, places, bytes_ in zip(hashes, widths, doc_ids, offsets, data, strict=True):
            if h.as_py() != digest:
                raise ValueError("a block was written with another dictionary")
            held, at, before, kind = memoryview(bytes_.as_buffer()), places.as_py(), 0, np.dtype(f"<u{width.as_py()}")
            for a, b in zip(at[:-1], at[1:], strict=True):
                found = np.frombuffer(expand.decompress(held[a:b]), kind).astype("<u4")
                sums.append(zlib.crc32(found))
                sizes.append(len(found))
                inside.append(before)
                before += len(found)
                if ids:
                    lists.append(found)
        if ids:
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, "<u4"), *lists]).astype(np.int64))
        else:
            lists = pa.nulls(len(sizes), pa.list_(pa.int64()))
        columns = [doc_ids.flatten(), *(pa.array(np.asarray(c, np.int64)) for c in (inside, sizes, sums)), lists]
        rows = pa.StructArray.from_arrays(columns, ["doc_id", "inside", "n_tokens", "ids_crc32", "ids"])
        counts = np.array([len(names) for names in doc_ids], np.int32)
        return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), rows)

    size = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = blocks.select("shard", "block", size.alias("size"))
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size")).select("shard", before(W.orderBy("shard")).alias("shard_start"))
    starts = sizes.select("shard", "block", before(W.partitionBy("shard").orderBy("block")).alias("block_start")).join(shards, "shard")
    docs = blocks.select("shard", "block", F.explode(unpacked("dict_hash", "width", "doc_ids", "offsets", "data")).alias("d"))
    out = docs.join(starts, ["shard", "block"])
    start = F.col("shard_start") + F.col("block_start") + F.col("d.inside")
    return out.select("d.doc_id", start.alias("start"), "d.n_tokens", "d.ids_crc32", *(["d.ids"] if ids else []))


def op8_token_ids(docs: DataFrame) -> DataFrame:
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder)
    return read_tokens(docs.sparkSession, folder, ids=False)
