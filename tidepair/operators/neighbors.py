"""Exact k-nearest-neighbour join that splits large groups into balanced regions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepair.plans.ordered import top_rows
from tidepair.plans.session import cut

LEAF_ROWS = "spark.tidepair.knnLeafRows"
MAX_DEPTH = 12  # at most 4096 regions: bounds the tree and the table of region boxes
_BLOCK = 512
_ASKED = 128
_PAIRS = 1 << 18  # pairs measured at once
SPREAD = 8  # regions that a point is sent to at most; one that needs more is asked where it is, and the points come by
ASK_ROWS = 8192  # such points that one task holds at most
_PACKED = 1 << 19  # bytes of vectors in one packed row of points; of asking points four times as many
_ROW_GROUP = 1 << 24  # bytes a reader of packed rows holds at once, or those of 100 rows


def _nearest(q, qid, p, pid, k):
    """k nearest p rows of every q row (self excluded), ties by id: (row index, ids, squared distances).

    Distances by matrix products only choose whom to look at, with a margin far above their rounding; those rows are
    measured and ordered exactly. Vectors that products can't measure (not finite) are all looked at.
    """
    rows, ids, dist = [], [], []
    p2 = (p ** 2).sum(axis=1)
    for start in range(0, len(q), _BLOCK):
        part = q[start:start + _BLOCK]
        own = qid[start:start + _BLOCK, None] == pid[None, :]
        q2 = (part ** 2).sum(axis=1)[:, None]
        rough = q2 + p2[None, :] - 2 * (part @ p.T)
        if len(p) > k and np.isfinite(rough).all():
            margin = 1e-9 * (q2 + p2.max())
            rough[own] = np.inf
            r, c = np.nonzero(~own & (rough <= np.partition(rough, k - 1, axis=1)[:, k - 1:k] + margin))
        else:
            r, c = np.nonzero(~own)
        d = np.concatenate([((part[r[i:i + _PAIRS]] - p[c[i:i + _PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(r), _PAIRS)] or [np.zeros(0)])
        good = np.isfinite(d)
        r, c, d = r[good], c[good], d[good]
        order = np.lexsort((pid[c], d, r))
        r, c, d = r[order], c[order], d[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[best] + start)
        ids.append(pid[c[best]])
        dist.append(d[best])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(dist)


class _Asking:
    """Points that look for neighbours among blocks of points that come by; keeps about k rows a point.

    `reach`: a distance within which k others are known, or infinity. As in _nearest, matrix products only choose whom to measure.
    """

    def __init__(self, ids, v, reach, own, k):
        self.ids, self.v, self.reach, self.own, self.k = ids, v, reach.copy(), own, k
        self.sq = (v ** 2).sum(axis=1)
        self.wide = np.concatenate([v, np.ones((len(v), 1))], axis=1)
        self.found = (np.zeros(0, dtype=int), np.zeros(0, dtype="int64"), np.zeros(0))
        self.more, self.n = [], 0

    def meet(self, leaf, ids, p):
        """A block of points of one region."""
        gap = np.maximum(0.0, np.maximum(p.min(axis=0) - self.v, self.v - p.max(axis=0)))
        rows = np.nonzero((self.own != leaf) & ((gap ** 2).sum(axis=1) <= self.reach))[0]
        p2 = (p ** 2).sum(axis=1)
        turned = np.concatenate([-2 * p, p2[:, None]], axis=1).T
        room = np.empty((min(len(rows), _ASKED), len(ids)))
        for start in range(0, len(rows), _ASKED):
            at = rows[start:start + _ASKED]
            rough = np.matmul(self.wide[at], turned, out=room[:len(at)])
            margin = 1e-9 * (self.sq[at] + p2.max())
            open_ = ~np.isfinite(self.reach[at])
            limit = self.reach[at] - self.sq[at] + margin
            if not np.isfinite(rough).all():
                limit[:], rough[:] = np.inf, 0.0
            elif open_.any() and len(ids) > self.k:
                limit[open_] = np.partition(rough[open_], self.k, axis=1)[:, self.k] + margin[open_]
            r, c = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(ids))
            for i in range(0, len(r), _PAIRS):
                a, b = at[r[i:i + _PAIRS]], c[i:i + _PAIRS]
                d = ((self.v[a] - p[b]) ** 2).sum(axis=1)
                good = np.isfinite(d) & (d <= self.reach[a]) & (ids[b] != self.ids[a])
                self.more.append((a[good], ids[b[good]], d[good]))
                self.n += int(good.sum())
                if self.n > max(_PAIRS, 2 * self.k * len(self.ids)):
                    self.settle()

    def settle(self):
        """(row, id, squared distance) of the k nearest so far, ties by id."""
        r, i, d = (np.concatenate([self.found[j], *[m[j] for m in self.more]]) for j in range(3))
        order = np.lexsort((i, d, r))
        r, i, d = r[order], i[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        last = place == self.k - 1
        self.reach[r[last]] = np.minimum(self.reach[r[last]], d[last])
        self.found, self.more, self.n = tuple(x[place < self.k] for x in (r, i, d)), [], 0
        return self.found


def _blocks(batch, keys, extra=(), size=_PACKED):
    """Rows of a batch in blocks of the same keys: (first row, rows, ids, vectors); vectors with entries that are not finite have no neighbours."""
    if not batch.num_rows:
        return
    ids, v = np.asarray(batch.column("_id")), np.asarray(batch.column("_v").flatten()).reshape(batch.num_rows, -1)
    step, fine = max(1, size // (8 * max(1, v.shape[1]))), np.isfinite(v).all(axis=1)
    names = batch.select([*keys, *extra]).to_pandas()
    groups = names.groupby(list(names.columns), sort=False).indices.values() if len(names.columns) else [np.arange(len(ids))]
    for at in groups:
        at = at[fine[at]]
        for i in range(0, len(at), step):
            rows = at[i:i + step]
            yield rows[:1], rows, ids[rows], np.ascontiguousarray(v[rows])


def _asked(points: DataFrame, asks: DataFrame, n: int, keys, kinds: str, k: int) -> DataFrame:
    """k nearest rows outside the own region of every row of asks (_leaf: minus the own region, _r: known reach), n in all.

    Asking rows are dealt to tasks by up to ASK_ROWS; each task reads all points past them, so nothing is listed per pair of
    row and region: what is shuffled are the asking rows once and their results.
    """
    tasks = points.sparkSession.sparkContext.defaultParallelism
    parts = -(-n // max(1, min(ASK_ROWS, max(512, -(-n // (4 * tasks))))))

    def pack_points(batches):
        for batch in batches:
            for first, _, ids, v in _blocks(batch, keys, ["_leaf"]):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in [*keys, "_leaf"]],
                                                  pa.array([ids.tobytes()]), pa.array([v.tobytes()])], [*keys, "_leaf", "_ids", "_vs"])

    def pack_asks(batches):
        number = 0
        for batch in batches:
            reach, own = np.asarray(batch.column("_r")), -np.asarray(batch.column("_leaf"))
            for first, rows, ids, v in _blocks(batch, keys, size=4 * _PACKED):
                arrays = [ids, v, reach[rows], own[rows]]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(first)) for c in keys], pa.array([number]), *[pa.array([a.tobytes()]) for a in arrays]],
                                                 ["_a" + c for c in keys] + ["_n", "_ai", "_av", "_ar", "_ao"])
                number += 1

    def search(batches):
        asking: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("_n")[i].as_py()
                read = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)  # noqa: B023, E731
                if number not in asking:
                    ids = read("_ai", "int64").copy()
                    asking[number] = (_Asking(ids, read("_av", "float64").reshape(len(ids), -1).copy(), read("_ar", "float64"), read("_ao", "int64").copy(), k),
                                      [pa.array([batch.column("_a" + c)[i].as_py()], batch.schema.field("_a" + c).type) for c in keys])
                ids = read("_ids", "int64")
                asking[number][0].meet(batch.column("_leaf")[i].as_py(), ids, read("_vs", "float64").reshape(len(ids), -1))
        for state, names in asking.values():
            r, ids, dist = state.settle()
            for i in range(0, len(r), _PAIRS):
                one = slice(i, i + _PAIRS)
                yield pa.RecordBatch.from_arrays([*[x.take(pa.array(np.zeros(len(r[one]), dtype=int))) for x in names],
                                                  pa.array(state.ids[r[one]]), pa.array(ids[one]), pa.array(dist[one])], [*keys, "_id", "neighbor", "dist2"])

    by = [*keys, "_leaf", "_id"]
    other = asks.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(
        pack_asks, "".join(f"`_a{c}` {d}, " for c, d in points.select(*keys).dtypes) + "_n long, _ai binary, _av binary, _ar binary, _ao binary")
    # a range test rather than an equi join, which would shuffle both sides
    same = (F.struct(*keys) >= F.struct(*["_a" + c for c in keys])) & (F.struct(*keys) <= F.struct(*["_a" + c for c in keys])) if keys else None
    packed = cut(points.mapInArrow(pack_points, kinds + "_leaf long, _ids binary, _vs binary"), **{"parquet.block.size": _ROW_GROUP})
    met = packed.coalesce(1).hint("shuffle_replicate_nl")
    met = met.join(other, same) if keys else met.crossJoin(other)
    return met.mapInArrow(search, kinds + "_id long, neighbor long, dist2 double")


def _frame(pdf):
    return np.stack(pdf["_v"].to_numpy()), pdf["_id"].to_numpy()


def _tree(sample, depth):
    """Median splits on the widest dimension, as flat arrays (heap order)."""
    dims, cuts = np.zeros(2 ** depth - 1, dtype=int), np.zeros(2 ** depth - 1)
    parts = {0: sample}
    for node in range(2 ** depth - 1):
        pts = parts.pop(node)
        if len(pts):
            dims[node] = int(np.argmax(pts.max(axis=0) - pts.min(axis=0)))
            cuts[node] = np.median(pts[:, dims[node]])
        right = pts[:, dims[node]] >= cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = pts[~right], pts[right]
    return dims, cuts


def knn_join(points: DataFrame, keys, id_col: str, vec_col: str, k: int, query_col: str | None = None) -> DataFrame:
    """Rows (keys, id, neighbour, dist2, rank) of the k nearest others within the same keys; exact.

    Groups of up to `spark.tidepair.knnLeafRows` rows are solved in one task. Larger groups are cut
    into balanced regions (median splits from a bounded sample); every point is solved in its own
    region, then sent only to regions whose box is closer than its k-th distance so far. A point that would go to more
    than SPREAD regions (many dimensions) is not sent: blocks of such points stay in tasks that read all points. So
    nothing written grows faster than the input, though measuring is quadratic then. `query_col` limits the asking rows.
    """
    spark, keys = points.sparkSession, list(keys)
    leaf_rows = int(spark.conf.get(LEAF_ROWS, "4000"))
    rows = points.select(*keys, F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"),
                         (F.col(query_col) if query_col else F.lit(True)).alias("_q"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.agg(F.sum(F.when(F.col("_n") > leaf_rows, F.col("_n")))).first()[0]
    kinds = ", ".join(f"`{c}` {d}" for c, d in points.select(*keys).dtypes) + (", " if keys else "")
    schema = kinds + "_id long, neighbor long, dist2 double"
    key_cols = keys
    text_keys = [c for c, d in points.select(*keys).dtypes if d == "string"] if keys else []

    def out(pdf, idx, ids, dist, q):
        base = q.iloc[idx][key_cols + ["_id"]].reset_index(drop=True)
        base = base.astype({c: object for c in text_keys})
        return base.assign(neighbor=ids, dist2=dist)[key_cols + ["_id", "neighbor", "dist2"]]

    def nothing(pdf):
        return pdf.iloc[:0][key_cols + ["_id"]].assign(neighbor=np.zeros(0, dtype="int64"), dist2=np.zeros(0))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf["_q"]].reset_index(drop=True)
        if not len(q) or len(pdf) < 2:
            return nothing(pdf)
        idx, ids, dist = _nearest(*_frame(q), *_frame(pdf), k)
        return out(pdf, idx, ids, dist, q)

    if not hot:
        near = rows.groupBy(*keys).applyInPandas(local, schema)
        return _ranked(near, keys, id_col, k)

    depth = min(MAX_DEPTH, max(1, int(np.ceil(np.log2(hot / leaf_rows)))))
    big = rows.join(sizes.where(F.col("_n") > leaf_rows).select(*keys), keys, "left_semi") if keys else rows
    want = 64 * 2 ** depth
    sample = np.array([r[0] for r in big.sample(min(1.0, want / hot), 11).select("_v").limit(2 * want).collect()])
    dims, cuts = _tree(sample, depth)

    def place(batches):
        for pdf in batches:
            v, node = np.stack(pdf["_v"].to_numpy()), np.zeros(len(pdf), dtype=int)
            for _ in range(depth):
                node = 2 * node + 1 + (v[np.arange(len(v)), dims[node]] >= cuts[node])
            yield pdf.astype({c: object for c in text_keys}).assign(_leaf=np.where(pdf["_big"], node, 0))

    flagged = rows.join(sizes.select(*keys, (F.col("_n") > leaf_rows).alias("_big")), keys) if keys else rows.withColumn("_big", F.lit(True))
    by = keys + ["_leaf"]  # points of a region lie together
    placed = cut(flagged.mapInPandas(place, kinds + "_id long, _v array<double>, _q boolean, _big boolean, _leaf long").repartition(*by).sortWithinPartitions(*by))
    own = cut(placed.drop("_big").groupBy(*keys, "_leaf").applyInPandas(local, schema))
    reach = own.groupBy(*keys, "_id").agg(F.count(F.lit(1)).alias("_c"), F.max("dist2").alias("_r"))
    asks = placed.where("_q AND _big").join(reach, keys + ["_id"], "left").select(
        *keys, "_id", "_v", "_leaf", F.when(F.col("_c") >= k, F.col("_r")).otherwise(F.lit(float("inf"))).alias("_r"))
    dim = F.posexplode("_v").alias("_d", "_x")
    boxes = placed.where("_big").select(*keys, "_leaf", dim).groupBy(*keys, "_leaf", "_d").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).groupBy(*keys, "_leaf").agg(
        F.sort_array(F.collect_list(F.struct("_d", "_lo", "_hi"))).alias("_b"))
    table: dict = {}
    for r in boxes.collect():  # at most 4096 regions per large group
        table.setdefault(tuple(r[c] for c in keys), []).append(
            (r["_leaf"], [b["_lo"] for b in r["_b"]], [b["_hi"] for b in r["_b"]]))
    table = {g: (np.array([b[0] for b in bs]), np.array([b[1] for b in bs]), np.array([b[2] for b in bs])) for g, bs in table.items()}
    shared = spark.sparkContext.broadcast(table)

    def visit(batches):
        for pdf in batches:
            pdf = pdf.astype({c: object for c in text_keys})  # plain objects: slices stay one Arrow array
            groups = pdf.groupby(key_cols, sort=False) if key_cols else [((), pdf)]
            for g, q in groups:
                leaves, lo, hi = shared.value[g if isinstance(g, tuple) else (g,)]
                v, r = np.stack(q["_v"].to_numpy()), q["_r"].to_numpy()
                for s in range(0, len(q), _BLOCK):
                    x = v[s:s + _BLOCK, None, :]
                    gap = np.maximum(0.0, np.maximum(lo[None] - x, x - hi[None]))
                    near = (gap ** 2).sum(axis=2) <= r[s:s + _BLOCK, None]
                    own = q["_leaf"].to_numpy()[s:s + _BLOCK]
                    near &= leaves[None, :] != own[:, None]
                    wide = near.sum(axis=1) > SPREAD
                    near[wide] = False
                    i, j = np.nonzero(near)
                    i, leaf = np.append(i, np.nonzero(wide)[0]), np.append(leaves[j], -own[wide])
                    if len(i):
                        yield q.iloc[s:s + _BLOCK].iloc[i].assign(_leaf=leaf)

    visits = cut(asks.mapInPandas(visit, kinds + "_id long, _v array<double>, _leaf long, _r double"))
    wide, sent = visits.where("_leaf < 0"), visits.where("_leaf > 0").drop("_r")
    # a region asked by more points than it has is solved in chunks, its own points repeated per chunk
    full = placed.where("_big").groupBy(*by).agg(F.greatest(F.count(F.lit(1)), F.lit(leaf_rows)).alias("_full"))
    load = sent.groupBy(*by).agg(F.count(F.lit(1)).alias("_asks")).join(full, by).select(*by, F.ceil(F.col("_asks") / F.col("_full")).alias("_chunks"))
    left = sent.join(load, keys + ["_leaf"]).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.col("_chunks"))).drop("_chunks")
    right = placed.where("_big").select(*keys, "_id", "_v", "_leaf").join(load, keys + ["_leaf"]).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))).drop("_chunks")

    def foreign(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return nothing(p if len(p) else q)
        q = q.reset_index(drop=True)
        idx, ids, dist = _nearest(*_frame(q), *_frame(p), k)
        return out(p, idx, ids, dist, q)

    group = keys + ["_leaf", "_chunk"]
    other = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(foreign, schema)
    near = own.unionByName(other)
    n_wide = wide.count()
    if n_wide:
        near = near.unionByName(_asked(placed.where("_big").select(*keys, "_id", "_v", "_leaf"), wide, n_wide, keys, kinds, k))
    return _ranked(near, keys, id_col, k)


def _ranked(near: DataFrame, keys, id_col: str, k: int) -> DataFrame:
    return top_rows(near, keys + ["_id"], ["dist2", "neighbor"], k, "rank").withColumnRenamed("_id", id_col)
