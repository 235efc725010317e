"""Near duplicates by HyperMinHash: compressed registers, bands, corrected estimates, exact sets, components."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, packed
from .shingles import mixed, shingle_hashes, word_stream

#: Registers (buckets of the leading hash bits), mantissa bits, registers a band, bands. A pair at similarity 0.8 shares
#: no band with probability (1 - 0.8**5)**48 = 5e-9.
REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 5, 48
SIMILARITY = 80  # percent
#: Nodes of a crowd that meet within their bands; larger crowds go by their consensus. Neither loses a link.
SMALL = 16
#: Steps from a home band to the home of its leader.
HOME_STEPS = 3
#: A pair is verified unless its estimate is this many standard deviations below the similarity (3e-7 of true pairs).
DEVIATIONS = 5.0
BYTES_AT_ONCE = 1 << 19
SIGNATURE = "struct<n:long,set_key:binary,registers:binary>"


@functools.cache
def lenders() -> np.ndarray:
    """Priority of each bucket to lend to each empty one; an empty bucket takes the first filled one."""
    place = np.arange(REGISTERS, dtype=np.uint64)
    return mixed(place[:, None] * np.uint64(REGISTERS) + place[None, :] + np.uint64(1))


def registers(distinct: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes: per bucket of the leading bits, the least remainder as
    leading-zero count and the MANTISSA bits behind its first one. Empty buckets borrow."""
    bucket = (distinct >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    rest = (distinct[first] >> np.uint64(4)) & np.uint64((1 << 52) - 1)  # 52 bits, exact as a float
    exponent = np.frexp(rest.astype(np.float64))[1]
    shifted = rest << (52 - exponent).astype(np.uint64)
    mantissa = (shifted >> np.uint64(51 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    own = ((52 - exponent).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    filled = bucket[first]
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = own
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = own[np.argmin(lenders()[np.ix_(empty, filled)], axis=1)]
    return out


def sets_of(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out, batch, held = [], [], 0

    def flush():
        words, begin = word_stream(batch)
        out.extend(np.unique(shingle_hashes(words[begin[i] : begin[i + 1]], size)) for i in range(len(batch)))

    for t in texts:
        batch.append((t or "").encode())
        held += len(batch[-1])
        if held >= BYTES_AT_ONCE:
            flush()
            batch, held = [], 0
    if batch:
        flush()
    return out


def signatures(size: int):
    """Column function of a text: size of its shingle set, 128-bit key of the set, registers (null for the empty set)."""
    kind = pa.struct([("n", pa.int64()), ("set_key", pa.binary()), ("registers", pa.binary())])

    def signed(texts: pa.Array) -> pa.Array:
        out = []
        for s in sets_of(texts.to_pylist(), size):
            key = np.array([s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()
            out.append({"n": len(s), "set_key": key if len(s) else None, "registers": registers(s).astype("<u2").tobytes() if len(s) else None})
        return pa.array(out, kind)

    return F.arrow_udf(signed, SIGNATURE)


def band_keys(regs: Column) -> Column:
    """Hashes of the bands of a register string."""

    def keys(strings: pa.Array) -> pa.Array:
        if not len(strings):
            return pa.array([], pa.list_(pa.int64()))
        r = np.frombuffer(b"".join(strings.to_pylist()), "<u2").reshape(-1, REGISTERS)[:, : ROWS * BANDS].astype(np.uint64)
        r = r.reshape(len(r), BANDS, ROWS)
        out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
        for k in range(ROWS):
            out = mixed(out * np.uint64(0x100000001B3) + r[:, :, k])
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, BANDS, dtype=np.int32), out.view(np.int64).ravel())

    return F.arrow_udf(keys, "array<long>")(regs)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m items agree: leading zeros by chance, then the mantissa."""
    level = np.arange(53)
    tail = lambda x: 1 - (1 - 0.5 ** np.append(level, 53)) ** np.maximum(1.0, x / REGISTERS)[:, None]
    a, b = tail(n), tail(m)
    return ((a[:, :-1] - a[:, 1:]) * (b[:, :-1] - b[:, 1:])).sum(axis=1) / (1 << MANTISSA)


def plausible(regs: Column, other: Column, n: Column, m: Column) -> Column:
    """Whether the collision-corrected estimate leaves a pair in reach of the similarity. Small sets have few different
    registers, so their estimate is given more room."""

    def estimate(a: pa.Array, b: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.bool_())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), "<u2").reshape(-1, REGISTERS) for s in (a, b))
        n, m = np.asarray(n, float), np.asarray(m, float)
        by_chance = chance(n, m)
        jaccard = ((x == y).mean(axis=1) - by_chance) / (1 - by_chance)
        s = SIMILARITY / 100
        room = DEVIATIONS * np.sqrt(s * (1 - s) / np.minimum(REGISTERS, np.maximum(n, m)))
        return pa.array(jaccard >= s - room)

    return F.arrow_udf(estimate, "boolean")(regs, other, n, m)


def linked(text: Column, other: Column, size: int) -> Column:
    """Whether the full shingle sets of two texts reach the similarity."""

    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):  # pair by pair: two texts are held at a time
            s, t = sets_of([x.as_py(), y.as_py()], size)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(100 * both >= SIMILARITY * (len(s) + len(t) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(exact, "boolean")(text, other)


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Connected components of undirected edges: (node, root), root the least node.

    Each round takes the least label among neighbours, then the label of that label, until nothing changes: the number of
    rounds is logarithmic in the paths' lengths. Rounds are written to the shared folder.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = cut(both)
    roots = cut(both.groupBy("node").agg(F.min("to").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("to"), "root"), "to").groupBy("node").agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        least = cut(least)
        jump = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(least.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "was"))
        if new.where("root <> was").limit(1).count() == 0:
            return new.select("node", "root")
        roots = new.select("node", "root")


def verified(pairs: DataFrame, nodes: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (u, v) whose estimate and then whose full sets reach the similarity."""
    of = lambda name: nodes.select(F.col("rid").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}"))
    kept = pairs.join(of("u"), "u").join(of("v"), "v")
    kept = kept.where(100 * F.least("n_u", "n_v") >= SIMILARITY * F.greatest("n_u", "n_v"))
    kept = cut(kept.where(plausible(F.col("r_u"), F.col("r_v"), F.col("n_u"), F.col("n_v"))).select("u", "v"))
    pair = kept.join(held.select(F.col("rid").alias("u"), F.col("text").alias("text_u")), "u")
    pair = pair.join(held.select(F.col("rid").alias("v"), F.col("text").alias("text_v")), "v")
    return cut(pair.where(linked(F.col("text_u"), F.col("text_v"), size)).select("u", "v"))


def set_hashes(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text."""

    def hashes(texts: pa.Array) -> pa.Array:
        sets = sets_of(texts.to_pylist(), size)
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))

    return F.arrow_udf(hashes, "array<long>")(text)


def crowds_of(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of open bands in crowds (crowd, node, own), the crowds with up to SMALL nodes, and the others.

    A crowd stands for a template. A node's home is the largest of its bands; the band's leader, its least node, may have
    a larger home itself, which then is the home of all; a few such steps bring the bands of one template together,
    without chaining templates that share a band by the way. A node belongs to its home (own) and visits the homes of
    all nodes that share a band with it. So two nodes with a common band always meet in the home of each. A band of N
    nodes knows at most 48 M / N homes of its size (M nodes in all), so visits stay linear in M a band.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader"))
    home = cut(left.join(sizes, "key").groupBy("node").agg(F.max(F.struct("size", "key", "leader")).alias("h")).select("node", "h.key", "h.leader"))
    next_ = home.select(F.col("node").alias("leader"), F.col("key").alias("to"))
    steps = cut(home.select("key", "leader").distinct().join(next_, "leader", "left").select("key", F.coalesce("to", "key").alias("to")))
    top = steps
    for _ in range(HOME_STEPS):
        onward = steps.select(F.col("key").alias("to"), F.col("to").alias("then"))
        top = cut(top.join(onward, "to", "left").select("key", F.coalesce("then", "to").alias("to")))
    own = cut(home.join(top, "key").select("node", F.col("to").alias("crowd")))
    homes = left.join(own, "node").select("key", "crowd").distinct()
    visits = left.join(homes, "key").select("crowd", "node").distinct()
    crowd = visits.join(own.withColumn("own", F.lit(True)), ["crowd", "node"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    crowd = cut(crowd)
    sizes = crowd.groupBy("crowd").agg(F.count(F.lit(1)).alias("members"), F.count_if("own").alias("owners"))
    crowd = crowd.join(sizes, "crowd")
    return crowd.where(F.col("members") <= SMALL).select("crowd", "node", "own"), crowd.where(F.col("members") > SMALL)


class Consensus:
    """Large crowds seen from their consensus B: the shingles that more than half of a crowd's own nodes hold. (Any
    set B would give the same links.)

    A node adds A shingles to B and lacks R of them. Two nodes e, x share |B| - |Re or Rx| + |Ae and Ax| shingles, so they
    reach the similarity only if they share at least 5/9 (Re + Rx) + 4/9 (Ae + Ax) - |B|/9 of their differences. A node
    whose similarity to B is itself too low (outer) has 5/9 Re + 4/9 Ae > |B|/9; so any x that it links with shares more
    than 5/9 Rx + 4/9 Ax differences with it, and hence, as at most Rx of them are lacks, more than 4/9 (Ax - Rx) added
    ones. That makes a complete search by the few added shingles: outer nodes need not meet the crowd, only those nodes
    that made the same change.
    """

    def __init__(self, crowd: DataFrame, nodes: DataFrame, held: DataFrame, size: int):
        texts = held.join(crowd, held["rid"] == crowd["node"]).select("crowd", "members", "owners", "node", "own", set_hashes(F.col("text"), size).alias("set"))
        self.rows = cut(texts.select("crowd", "members", "owners", "node", "own", F.explode("set").alias("h")))
        counts = self.rows.groupBy("crowd", "h").agg(F.count(F.lit(1)).alias("c"), F.count_if("own").alias("c_own"), F.max("members").alias("members"), F.max("owners").alias("owners"))
        self.counts = cut(counts.withColumn("core", 2 * F.col("c_own") > F.col("owners")))
        core = self.counts.groupBy("crowd").agg(F.count_if("core").alias("n_b"))
        marked = self.rows.join(self.counts.where("c > 1").select("crowd", "h", "c", "core"), ["crowd", "h"], "left")
        self.marked = cut(marked.select("crowd", "node", "own", "h", F.coalesce("c", F.lit(1)).alias("c"), F.coalesce("core", F.lit(False)).alias("core")))
        per_node = self.marked.groupBy("crowd", "node", "own").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core")).join(core, "crowd")
        far = 100 * F.col("n_core") < SIMILARITY * (F.col("n") + F.col("n_b") - F.col("n_core"))
        self.nodes = cut(per_node.select("crowd", "node", "own", "n", "n_b", (F.col("n") - F.col("n_core")).alias("a"), (F.col("n_b") - F.col("n_core")).alias("r"), far.alias("outer")))

    def star(self) -> DataFrame:
        """Pairs of the own node nearest to the consensus with each other node of its crowd that is not outer or its own."""
        nearest = self.nodes.where("own").groupBy("crowd").agg(F.min(F.struct(5 * F.col("r") + 4 * F.col("a"), "node")).alias("m")).select("crowd", F.col("m.node").alias("u"))
        return self.nodes.where("own OR NOT outer").join(nearest, "crowd").where("node <> u").select("u", F.col("node").alias("v")).distinct()

    def changes(self, roots: DataFrame) -> DataFrame:
        """Open differences (crowd, lacks, h, what is known of the node) of nodes: those that an outer node makes and one of
        another component has in its index, the rarest of its differences that are enough for the search. Lacks are there
        for outer nodes and for those that lack more than they add, and listed in the index of the latter only. A node's
        numbers come to its differences as the first row of its own, so all of them meet no join; most are dropped then,
        as one node or one component makes them."""
        about = self.nodes.join(roots, "node", "left").select("crowd", "node", F.struct("own", "n", "n_b", "a", "r", "outer", F.coalesce("root", "node").alias("root")).alias("about"))
        first = about.select("crowd", "node", "about", F.lit(False).alias("lacks"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("c"), F.lit(False).alias("listed"))
        added = self.marked.where("NOT core").select("crowd", "node", F.lit(False).alias("lacks"), "h", "c", F.lit(True).alias("listed"))
        wanted = self.nodes.where("outer OR a < r").select("crowd", "node", F.expr("a < r").alias("listed"))
        all_ = wanted.join(self.counts.where("core").select("crowd", "h", (F.col("members") - F.col("c")).alias("c")), "crowd")
        lacks = all_.join(self.marked.where("core").select("crowd", "node", "h"), ["crowd", "node", "h"], "left_anti")
        lacks = lacks.select("crowd", "node", F.lit(True).alias("lacks"), "h", "c", "listed")
        rarest = W.partitionBy("crowd", "node").orderBy("c", "lacks", "h")
        rows = first.unionByName(added.unionByName(lacks), allowMissingColumns=True)
        rows = rows.withColumn("at", F.count_if("listed").over(rarest)).withColumn("about", F.first("about").over(rarest))
        rows = rows.where("c > 1").select("crowd", "node", "lacks", "h", "listed", "at", "about.*")
        full = F.col("a") >= F.col("r")
        enough = F.when(full, F.col("a") - F.floor(4 * (F.col("a") - F.col("r")) / 9)).otherwise(F.col("a") + F.col("r") - F.floor((5 * F.col("r") + 4 * F.col("a")) / 9))
        rows = cut(rows.withColumn("index", F.col("listed") & (F.col("at") <= enough)).where("outer OR index").drop("listed", "at"))
        open_ = rows.groupBy("crowd", "lacks", "h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("outer").alias("asks"), F.max("index").alias("answers"))
        return rows.join(open_.where("low < high AND asks AND answers").select("crowd", "lacks", "h"), ["crowd", "lacks", "h"], "left_semi")

    def pairs(self, roots: DataFrame) -> DataFrame:
        """Pairs of different components, at least one of them outer, that can reach the similarity."""
        rows = cut(self.changes(roots))
        index = rows.where("index")
        index = index.select("crowd", "lacks", "h", F.col("n_b"), *[F.col(c).alias(f"{c}_x") for c in ("node", "own", "n", "a", "r", "root")])
        probe = rows.where("outer").select("crowd", "lacks", "h", "node", "own", "n", "a", "r", "root")
        fits = (F.col("root") != F.col("root_x")) & (F.col("own") | F.col("own_x")) & (100 * F.least("n", "n_x") >= SIMILARITY * F.greatest("n", "n_x"))
        fits &= 9 * (F.least("a", "a_x") + F.least("r", "r_x")) >= 5 * (F.col("r") + F.col("r_x")) + 4 * (F.col("a") + F.col("a_x")) - F.col("n_b")
        return probe.join(index, ["crowd", "lacks", "h"]).where(fits).select(F.least("node", "node_x").alias("u"), F.greatest("node", "node_x").alias("v")).distinct()


def in_bands(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of the given nodes (crowd, node, own, root) that share a band and a crowd that is home to one of them, are in
    different components and aren't its head's. Where all nodes of a crowd in a band are in one component, none is left."""
    mine = left.where("node <> head").select("key", "node").join(nodes, "node")
    open_ = mine.groupBy("key", "crowd").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.max("own").alias("any")).where("a <> b AND any")
    mine = cut(mine.join(open_.select("key", "crowd"), ["key", "crowd"]))
    other = mine.select("key", "crowd", F.col("node").alias("v"), F.col("root").alias("root_v"), F.col("own").alias("own_v"))
    pair = mine.join(other, ["key", "crowd"]).where("root < root_v AND (own OR own_v)")
    return pair.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()


def classes(docs: DataFrame, text: str = "text", size: int = 5, carry: tuple = ("*",)) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate classes: rows (row: the columns to carry, rid, n_shingles) and labels (rid, root).

    Words are runs between white space, A-Z lower-cased; a text's set has its distinct shingles of so many words (all
    words as one if there are fewer). Texts are linked from SIMILARITY percent Jaccard similarity on; root is the least
    rid of the linked component, null for texts without words, which are linked with nothing. rid numbers rows; equal
    sets are one node, so exact copies cost one signature. An empty table gives no rows; columns of other names, clashing
    ones too, ride along in row; a text's set is made in one task.

    Candidates share a band. In a first round every node meets the least node of each of its bands, which is linear in
    the bands. Bands whose nodes are still in different components are open; their nodes form crowds around the largest
    bands. Crowds of up to SMALL nodes meet within their bands. In larger ones every node meets the node nearest to the crowd's consensus,
    outer nodes (see Consensus) meet those that share their changes, and the others meet within the bands that are still
    open. No link between components is lost. All rounds verify the full sets. Shingles are compared by 64-bit hashes.
    """
    whole = carry == ("*",)
    signed = packed(docs, text, carry=carry).withColumn("rid", F.monotonically_increasing_id())
    signed = signed.withColumn("s", signatures(size)(F.col(f"row_{text}"))).withColumnRenamed(f"row_{text}", "text")
    signed = cut(signed.select("row", "rid", "s.*", *([] if whole else ["text"])))
    filled = signed.where(F.col("set_key").isNotNull())
    texts = filled.select("rid", (F.col("row").getField(text) if whole else F.col("text")).alias("text"))
    keys = cut(filled.groupBy("set_key").agg(F.min("rid").alias("rid")))
    nodes = cut(filled.select("rid", "n", "registers").join(keys.select("rid"), "rid"))
    bands = nodes.select("rid", F.explode(band_keys(F.col("registers"))).alias("key"))
    heads = bands.groupBy("key").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "head")
    shared = cut(bands.join(heads, "key"))
    held = cut(texts.join(shared.select("rid").distinct(), "rid").select("rid", "text"))  # texts with any candidate
    links = verified(shared.where("rid <> head").select(F.col("head").alias("u"), F.col("rid").alias("v")).distinct(), nodes, held, size)
    roots = components(links)
    with_root = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    member = cut(with_root(shared.select("key", "head", F.col("rid").alias("node"))))
    open_ = member.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = cut(member.join(open_, "key").select("key", "head", "node"))
    small, large = crowds_of(left)
    consensus = Consensus(large, nodes, held, size)
    star = with_root(consensus.star().withColumnRenamed("v", "node")).withColumnRenamed("root", "root_v")
    star = star.join(roots.select(F.col("node").alias("u"), F.col("root").alias("root_u")), "u", "left")
    star = star.where("coalesce(root_u, u) <> root_v").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
    links = cut(links.union(verified(star, nodes, held, size)))
    roots = components(links)
    inner = consensus.nodes.where("NOT outer").select("crowd", "node", "own")
    rest = in_bands(left, with_root(small.union(inner))).union(consensus.pairs(roots)).distinct()
    roots = components(links.union(verified(rest, nodes, held, size)))
    root = keys.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("set_key", F.coalesce("root", "rid").alias("root"))
    labels = signed.select("rid", "set_key").join(root, "set_key", "left").select("rid", "root")
    return signed.select("row", "rid", F.col("n").alias("n_shingles")), labels


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5) -> DataFrame:
    """One document of each near-duplicate class, the one of least key (nulls last), with its own columns.

    Texts without words all stay. Of repeated rows one stays.
    """
    rows, labels = classes(docs, text, size)
    order = F.struct(F.col(f"row.{key}").isNull().alias("none"), F.col(f"row.{key}").alias("key"), "rid")
    ranked = rows.select("rid", order.alias("order")).join(labels, "rid")
    first = ranked.groupBy(F.coalesce(F.col("root"), -1 - F.col("rid"))).agg(F.min("order").alias("order")).select(F.col("order.rid").alias("rid"))
    return rows.join(first, "rid", "left_semi").select("row.*")


def op6_minhash_near_dedup(docs: DataFrame) -> DataFrame:
    """Contract of op6: shingles of two words."""
    rows, labels = classes(docs, size=2, carry=("doc_id",))
    found = cut(rows.select("row.doc_id", "rid", "n_shingles").join(labels, "rid"))
    least = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    out = found.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
