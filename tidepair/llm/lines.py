"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import drop_cuts, ready, shared_folder
from .shingles import mixed

GAPS = b" \t\n\x0b\x0c\r"
#: Code points a key needs to count; keys a shard is laid out for; slots a bucket; how full a filter may become.
LEAST_CHARS, SHARD_KEYS, SLOTS, LOAD = 10, 200_000, 4, 0.85
#: Keys with more than this share of all postings are broadcast instead of shuffled: at most 1 / share of them exist.
HOT_SHARE = 1 / 2000


class CuckooFilter:
    """Cuckoo filter with 16-bit fingerprints, four to a bucket. Both buckets of a fingerprint follow from either one, so
    fingerprints can move and be taken out again. All steps work on arrays of 64-bit hashes."""

    def __init__(self, buckets: int = 16, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.random = np.random.default_rng(13)

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets."""
        mark = (hashes >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """False: surely not inserted. True: inserted, or one of about 1 in 8,000 others."""
        mark, a, b = self.places(hashes)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; returns which found none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        free = self.table[b] == 0
        slot = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)  # slot of the rank-th free one
        fits = free.sum(axis=1) > rank
        self.table[b[fits], slot[fits]] = mark[order][fits]
        left = np.ones(len(mark), bool)
        left[order[fits]] = False
        return left

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """Insert distinct keys. False if the filter is too full: it is left as it was, to be laid out larger."""
        if len(self) + len(hashes) > LOAD * self.table.size:
            return False
        before = self.table.copy()
        mark, a, b = self.places(hashes)
        left = self.settle(mark, a)
        mark, bucket = mark[left], b[left]
        for _ in range(rounds):
            if not len(mark):
                return True
            left = self.settle(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            # one fingerprint a bucket changes places with one that is there, which goes on to its other bucket
            _, one = np.unique(bucket, return_index=True)
            waits = np.ones(len(mark), bool)
            waits[one] = False
            at, slot = bucket[one], self.random.integers(0, SLOTS, len(one))
            moved = self.table[at, slot].copy()
            self.table[at, slot] = mark[one]
            mark, bucket = np.concatenate((moved, mark[waits])), np.concatenate((self.other(at, moved), bucket[waits]))
        self.table = before
        return False

    def delete(self, hashes: np.ndarray) -> int:
        """Take distinct inserted keys out; returns how many had no fingerprint (0 unless never inserted)."""
        mark, a, b = self.places(hashes)
        missing = 0
        while len(mark):
            # keys of equal fingerprint and buckets go one at a time
            _, one = np.unique(np.minimum(a, b) << 16 | mark.astype(np.int64), return_index=True)
            m, left = mark[one], np.ones(len(one), bool)
            for bucket in (a[one], b[one]):
                hit = (self.table[bucket] == m[:, None]) & left[:, None]
                found = hit.any(axis=1)
                self.table[bucket[found], np.argmax(hit, axis=1)[found]] = 0
                left &= ~found
            missing += int(left.sum())
            waits = np.ones(len(mark), bool)
            waits[one] = False
            mark, a, b = mark[waits], a[waits], b[waits]
        return missing


def laid_out(hashes: np.ndarray) -> CuckooFilter:
    """A filter with room for these keys, larger if they do not settle."""
    buckets = 1 << max(4, math.ceil(math.log2(max(1, len(hashes)) / (SLOTS * LOAD))))
    while True:
        out = CuckooFilter(buckets)
        if out.insert(hashes):
            return out
        buckets *= 2


def line_keys(text: str | None) -> list[bytes | None]:
    """Key of every line: 128-bit MD5 of the line without white space at its ends, A-Z lower-cased; null where that has
    fewer than LEAST_CHARS characters."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        bare = line.strip(GAPS)
        short = len(bare) < LEAST_CHARS or len(bare) < 4 * LEAST_CHARS and len(bare.decode()) < LEAST_CHARS
        out.append(None if short else hashlib.md5(bare.lower(), usedforsecurity=False).digest())
    return out


def keys_of(text: Column) -> Column:
    """Distinct keys of a text's lines."""

    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([list(dict.fromkeys(k for k in line_keys(t.as_py()) if k)) for t in texts], pa.list_(pa.binary()))

    return F.arrow_udf(keys, "array<binary>")(text)


CLEANED = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def without(text: Column, drop: Column) -> Column:
    """A text without the lines of the keys to drop, its number of lines before and of dropped ones."""

    def cleaned(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts, drops, strict=True):
            t, gone = t.as_py() or "", set(d.as_py() or ())
            lines = t.split("\n")
            kept = [x for x, k in zip(lines, line_keys(t), strict=True) if k not in gone] if gone else lines
            out.append({"text": "\n".join(kept) if gone else t, "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
        return pa.array(out, CLEANED)

    return F.arrow_udf(cleaned, "struct<text:string,n_lines:long,n_dropped:long>")(text, drop)


def hashes_of(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8")[::2]


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


FILTER = "shard int, filter binary"


def new_filters(counts: DataFrame, shards: int) -> DataFrame:
    """One filter a shard over all keys of the exact table."""

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table["shard"].slice(0, 1).cast(pa.int32()), "filter": [laid_out(hashes_of(table["key"])).to_bytes()]})

    return counts.select("key", shard_of(F.col("key"), shards).alias("shard")).groupBy("shard").applyInArrow(build, FILTER)


def probed(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Adds maybe: whether the filter of a key's shard may hold it (never false for a key that it holds)."""

    def look(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        hits = np.zeros(len(mine), bool)
        if len(mine) and len(theirs):
            hits = CuckooFilter.of_bytes(theirs["filter"][0].as_py()).contains(hashes_of(mine["key"]))
        return mine.drop_columns(["shard"]).append_column("maybe", pa.array(hits)).cast(kind)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields) + ", maybe boolean"
    kind = to_arrow_schema(StructType.fromDDL(names))
    mine = keys.withColumn("shard", shard_of(F.col("key"), shards))
    return mine.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(look, names)


def changed_filters(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Filters after inserting (gone: false) or taking out (gone: true) keys; null where the keys found no room."""

    def change(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        data = theirs["filter"][0].as_py() if len(theirs) else CuckooFilter().to_bytes()
        if len(mine):
            out, gone = CuckooFilter.of_bytes(data), np.asarray(mine["gone"])
            hashes = hashes_of(mine["key"])
            missing = out.delete(hashes[gone])
            data = out.to_bytes() if not missing and out.insert(hashes[~gone]) else None
        shard = (mine if len(mine) else theirs)["shard"].slice(0, 1).cast(pa.int32())
        return pa.table({"shard": shard, "filter": pa.array([data], pa.binary())})

    mine = keys.select("key", "gone", shard_of(F.col("key"), shards).alias("shard"))
    return mine.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(change, FILTER)


def summed(postings: DataFrame) -> DataFrame:
    """Exact reference counts: per key the documents that hold it, the least and the greatest of their ids (nulls last).
    A key of very many documents is combined before the shuffle."""
    holder = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("id"))
    return postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min(holder).alias("least"), F.max(holder).alias("greatest"))


class LineIndex:
    """Which lines stand in which documents, in a folder of Parquet tables; documents can be inserted and deleted.

    postings: (doc, key), one row for each key of a document, as inserted, never shuffled. counts: exact references of
    each key. filters: one cuckoo filter a shard of keys. An insertion asks the filters first: keys that they surely do
    not hold are new and need no lookup, only the others meet the exact table; new keys enter the filters. A deletion
    takes its references off again, finds the next holder of a key in the postings, and takes keys without references
    out of the filters. So inserting and then deleting documents leaves the index as before, in any order.

    Every change writes new tables and then takes them over, so one that fails leaves the index as it was. Shards grow
    with the keys: about SHARD_KEYS each, a task's work.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, doc: str = "doc_id", text: str = "text"):
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.doc, self.text, self.shards, self.version = doc, text, 1, 0
        self.postings_paths: list[str] = []
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        ready(spark)

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def lines(self, docs: DataFrame) -> DataFrame:
        return docs.select(F.col(self.doc).alias("doc"), F.explode(keys_of(F.col(self.text))).alias("key"))

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(*self.postings_paths)

    def _take_over(self, counts: DataFrame, changes: DataFrame | None) -> None:
        """Make counts and the filters that belong to them the index's own. changes: keys that came or went."""
        shards = max(self.shards, 1 << math.ceil(math.log2(max(1, counts.count() / SHARD_KEYS))))
        filters = None
        if changes is not None and shards == self.shards:
            filters, path = self._write(changed_filters(self.filters, changes, shards), "filters")
            if filters.where("filter IS NULL").limit(1).count():
                drop_cuts(self.spark, [path])
                filters = None
        if filters is None:
            filters, _ = self._write(new_filters(counts, shards), "filters")
        self.counts, self.filters, self.shards = counts, filters, shards

    def insert(self, docs: DataFrame) -> None:
        """Add documents. A document inserted twice counts twice, and both go with one deletion."""
        postings, path = self._write(self.lines(docs), "postings")
        if self.counts is None:
            counts, _ = self._write(summed(postings), "counts")
            changes = None
        else:
            fresh, spent = self._write(probed(summed(postings), self.filters, self.shards), "fresh")
            hits = fresh.where("maybe").select("key", *[F.col(c).alias(f"new_{c}") for c in ("refs", "least", "greatest")])
            new = fresh.where("NOT maybe").select("key", "refs", "least", "greatest", F.lit(True).alias("new"))
            met = self.counts.join(hits, "key", "full_outer").select(
                "key", (F.coalesce("refs", F.lit(0)) + F.coalesce("new_refs", F.lit(0))).alias("refs"), F.least("least", "new_least").alias("least"),
                F.greatest("greatest", "new_greatest").alias("greatest"), F.col("refs").isNull().alias("new"))
            counted, _ = self._write(met.unionByName(new), "counts")
            counts, changes = counted.drop("new"), counted.where("new").select("key", F.lit(False).alias("gone"))
        self._take_over(counts, changes)
        self.postings_paths.append(path)
        if changes is not None:
            drop_cuts(self.spark, [spent])

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose id stands in column doc of ids (null: those without id)."""
        if self.counts is None:
            return
        mark = ids.select(F.col(self.doc).alias("_id")).distinct().withColumn("_gone", F.lit(True))
        told, told_path = self._write(self.postings().join(mark, F.col("doc").eqNullSafe(F.col("_id")), "left").drop("_id"), "told")
        left, path = self._write(told.where("_gone IS NULL").drop("_gone"), "postings")
        touched, spent = self._write(told.where("_gone").select("key").distinct(), "touched")
        again = summed(left.join(touched, "key", "left_semi"))
        counts, _ = self._write(self.counts.join(touched, "key", "left_anti").unionByName(again), "counts")
        gone = touched.join(counts, "key", "left_anti").select("key", F.lit(True).alias("gone"))
        self._take_over(counts, gone)
        was, self.postings_paths = self.postings_paths, [path]
        drop_cuts(self.spark, [told_path, spent, *was])

    def clean(self, docs: DataFrame, name: str = "cleaned") -> DataFrame:
        """Adds a struct column (text, n_lines, n_dropped): lines whose key several documents of the index hold are
        dropped, except in the holder of least id. Keys that are very frequent are broadcast (at most 1 / HOT_SHARE)."""
        lines, _ = self._write(self.lines(docs), "looked")
        shared = self.counts.where("least <> greatest").select("key", "least", "refs")
        much = F.broadcast(self.counts.agg((F.sum("refs") * HOT_SHARE).alias("much")))
        shared = shared.join(much)
        hot, rare = shared.where("refs > much").select("key", "least"), shared.where("refs <= much").select("key", "least")
        met = lines.join(F.broadcast(hot), "key").unionByName(lines.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rare, "key"))
        drops = met.where(~F.col("doc").eqNullSafe(F.col("least.id"))).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("key").alias("_drop"))
        out = docs.join(drops, F.col(self.doc).eqNullSafe(F.col("_doc")), "left")
        return out.withColumn(name, without(F.col(self.text), F.col("_drop"))).select(*docs.columns, name)


def drop_repeated_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "cleaned", feeds: int = 2) -> DataFrame:
    """Adds a struct column (text, n_lines, n_dropped): each text without the lines that another document of lesser id
    holds.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of LEAST_CHARS characters on count.
    Documents enter a LineIndex in feeds, by a hash of their id, as an index that grows does. Null and empty texts are
    one empty line; a null id comes after all others; rows of equal id are one document; an empty table stays empty;
    names starting with _ apart, other columns stay. Lines of a text are handled in one task, in memory of a few times
    the text.
    """
    index, turn = LineIndex(docs.sparkSession, doc=doc, text=text), F.pmod(F.xxhash64(F.col(doc)), F.lit(feeds))
    for feed in range(feeds):
        index.insert(docs.where(turn == feed))
    return index.clean(docs, name)


def op13_line_dedup(docs: DataFrame) -> DataFrame:
    rows = drop_repeated_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2(F.col("cleaned.text"), 256).alias("kept_sha256"))
