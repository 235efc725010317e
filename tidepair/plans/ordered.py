"""Ordered computations (running totals, ranks, quantiles) that survive hot groups.

A plain window sends each group to one task. Here the group sizes are counted
first (map-side combined); only when some group exceeds `hot_rows` is it dealt
to range partitions, windowed per part, and shifted by the totals of the parts
before it. Without a hot group the plan is the plain window. A null key is a
group like any other: groups are joined back null-safely.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import broadcast_rows, cut, cut_counted, hot_rows


def _sort(order):
    """order: list of (column name, ascending)."""
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def _asc(order):
    return [(c, True) if isinstance(c, str) else c for c in order]


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet each other; the keys of the left side stay."""
    keys = list(keys)
    for k in keys:
        right = right.withColumnRenamed(k, "_on_" + k)
    test = F.lit(True)
    for k in keys:
        test = test & left[k].eqNullSafe(right["_on_" + k])
    return left.join(right, test, how).drop(*["_on_" + k for k in keys])


def split_hot(df: DataFrame, keys, order, probe: DataFrame | int | None = None):
    """Returns (rows with `_part`, hot group count, parts); hot group count 0 = untouched.

    `probe`: cheaper frame with the same keys whose group sizes bound those of `df`,
    or a proven bound on the group size (then no counting job is needed).
    """
    spark = df.sparkSession
    limit = hot_rows(spark)
    if isinstance(probe, int):
        if probe <= limit:
            return df, 0, 0
        probe = None
    hot = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > limit)
    groups, total = hot.agg(F.count(F.lit(1)), F.sum("_size")).first()
    if not groups:
        return df, 0, 0
    parts = max(2, 2 * (total // limit + 1))
    if keys:
        flags = hot.select(*keys, F.lit(True).alias("_hot"))
        if groups <= broadcast_rows(spark):
            flags = F.broadcast(flags)
        rows = join_on(df, flags, keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    else:
        rows = df.withColumn("_hot", F.lit(True))
    dealt = rows.where("_hot").repartitionByRange(parts, *_sort(order)).withColumn("_part", F.spark_partition_id() + 1)
    return cut(dealt).unionByName(rows.where(~F.col("_hot")).withColumn("_part", F.lit(0))), groups, parts


def running(df: DataFrame, keys, order, sums: dict, probe: DataFrame | int | None = None) -> DataFrame:
    """Inclusive running totals; `sums` maps new column -> summed column or expression."""
    keys, order = list(keys), _asc(order)
    for out, what in sums.items():
        df = df.withColumn("_in_" + out, what if isinstance(what, Column) else F.col(what))
    rows, groups, parts = split_hot(df, keys, order, probe)
    group = keys + (["_part"] if groups else [])
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    w = w.orderBy(*_sort(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows
    if groups:
        w_before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_part")
        w_before = w_before.rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.where("_hot").groupBy(*group).agg(*[F.sum("_in_" + c).alias("_t_" + c) for c in sums])
        before = totals.select(
            *group, *[F.coalesce(F.sum("_t_" + c).over(w_before), F.lit(0)).alias("_b_" + c) for c in sums])
        if groups * parts <= broadcast_rows(df.sparkSession):
            before = F.broadcast(before)
        out = join_on(out, before, group, "left")
    for c in sums:
        value = F.sum("_in_" + c).over(w)
        if groups:
            value = value + F.coalesce(F.col("_b_" + c), F.lit(0))
        out = out.withColumn(c, value)
    spare = ["_in_" + c for c in sums] + ["_b_" + c for c in sums] + ["_part", "_hot"]
    return out.drop(*spare)


def row_rank(df: DataFrame, keys, order, out: str, probe: DataFrame | int | None = None) -> DataFrame:
    """1-based unique rank. `order` must end in a column that breaks every tie."""
    return running(df, keys, order, {out: F.lit(1).cast("bigint")}, probe)


def with_totals(df: DataFrame, keys, **aggs) -> DataFrame:
    """Attach per-group aggregates: partial aggregation plus an equi join (AQE splits skew)."""
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_on(df, totals, keys) if keys else attach_one(df, totals)


def attach_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a single-row frame as scalar subqueries."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one"))
    out = df.withColumn("_one", packed.scalar())
    for c in one_row.columns:
        out = out.withColumn(c, F.col("_one." + c))
    return out.drop("_one")


def value_counts(df: DataFrame, keys, value: str, probe: DataFrame | int | None = None) -> DataFrame:
    """Per group and distinct non-null value: n, cumulative n."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return running(counts, keys, [value], {"_cum": "_n"}, probe)


def is_hot(df: DataFrame, keys, probe: DataFrame | int | None = None, limit: int | None = None) -> bool:
    """Does some group exceed what one task should hold (or another limit)?"""
    limit = hot_rows(df.sparkSession) if limit is None else limit
    if isinstance(probe, int):
        if probe <= limit:
            return False
        probe = None
    sizes = (df if probe is None else probe).groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return (sizes.agg(F.max("_size")).first()[0] or 0) > limit


#: Buckets of group_bound().
BOUND_BUCKETS = 1 << 14


def group_bound(df: DataFrame, keys, n: int) -> int:
    """A proven bound on the size of df's groups, n being that of df: where n is too much for one task, the size of the
    largest of a fixed number of buckets of groups, which a shuffle of a few counts a task finds."""
    if n <= hot_rows(df.sparkSession):
        return n
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BOUND_BUCKETS)).alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    return int(buckets.agg(F.max("_size")).first()[0] or 0)


def avg_rank(df: DataFrame, keys, value: str, out: str, probe: DataFrame | int | None = None,
             count: str | None = None) -> DataFrame:
    """Average-tie ascending rank of non-null values (null stays null); `count` adds the non-null count."""
    keys = list(keys)
    if not is_hot(df, keys, probe):
        group = Window.partitionBy(*keys)
        rank = F.rank().over(group.orderBy(F.col(value).asc_nulls_last()))
        ties = F.count(value).over(Window.partitionBy(*keys, value))
        df = df.withColumn(out, F.when(F.col(value).isNotNull(), rank + (ties - 1) / F.lit(2.0)))
        return df.withColumn(count, F.count(value).over(group)) if count else df
    ranks = value_counts(df, keys, value, probe).select(
        *keys, value, (F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    df = join_on(df, ranks, keys + [value], "left")
    return with_totals(df, keys, **{count: F.count(value)}) if count else df


def percent_rank_avg(df: DataFrame, keys, value: str, out: str, builder: bool = True,
                     probe: DataFrame | int | None = None) -> DataFrame:
    """Average-tie rank / non-null count. Builder variant: <=1 valid gives 1.0, null gives 0."""
    ranked = avg_rank(df, keys, value, "_r", probe, "_m")
    share = F.col("_r") / F.col("_m")
    if builder:
        share = F.when(F.col("_m") <= 1, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))
    return ranked.withColumn(out, share).drop("_r", "_m")


def quantiles(df: DataFrame, keys, value: str, qs: dict, probe: DataFrame | int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group; `qs` maps column -> probability.

    `percentile` keeps a group's distinct values in one task, so beyond `hot_rows`
    distinct values the positions are found from distributed cumulative counts.
    """
    keys = list(keys)
    valid = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    if not is_hot(valid, keys, probe):
        return valid.groupBy(*keys).agg(*[F.percentile(value, F.lit(q)).alias(n) for n, q in qs.items()])
    steps = value_counts(valid, keys, value)
    steps = join_on(steps, sizes, keys) if keys else attach_one(steps, sizes)
    picks = []
    for n, q in qs.items():
        h = (F.col("_size") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("_cum") > at) & (F.col("_cum") - F.col("_n") <= at)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{n}"))
        picks.append(F.max(h - F.floor(h)).alias("_f_" + n))
    found = steps.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col("_lo_" + n) + (F.col("_hi_" + n) - F.col("_lo_" + n)) * F.col("_f_" + n)).alias(n) for n in qs])


#: Rows of a group beyond which bh_fdr works on its distinct p values rather than sort the group in one task.
BH_ROWS = 250_000


def bh_fdr(df: DataFrame, keys, p: str, out: str, probe: DataFrame | int | None = None, values: DataFrame | None = None) -> DataFrame:
    """Benjamini-Hochberg q per group over finite p; null p stays null.

    Works on distinct p values where groups are large: a tied block shares the q of its last rank. Their counts are written
    once, and every row looks its q up. `values`: cheaper frame with the same keys and p, if there is one.
    """
    keys = list(keys)
    finite = lambda rows: rows.withColumn(p, F.nanvl(F.col(p), F.lit(None).cast("double")))
    df = finite(df)
    values = df if values is None else finite(values)
    if not is_hot(values if probe is None else df, keys, probe, min(BH_ROWS, hot_rows(df.sparkSession))):
        group = Window.partitionBy(*keys)
        upto = group.orderBy(F.col(p).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        after = group.orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn("_raw", F.col(p) * F.count(p).over(group) / F.count(p).over(upto))
        q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("_raw").over(after)))
        return df.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("_raw")
    q = bh_steps(values, keys, p, out).select(*keys, p, out, F.lit(0).cast("bigint").alias("_at"))
    # rows without p find nothing: spread, so that they don't meet in one task
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    rows = df.withColumn("_at", F.when(F.col(p).isNull(), F.xxhash64(*plain)).otherwise(0))
    return join_on(rows, q, [*keys, p, "_at"], "left").drop("_at")


def bh_steps(values: DataFrame, keys, p: str, out: str) -> DataFrame:
    """Distinct finite p values per group with the rows up to each (_cum) and their Benjamini-Hochberg q."""
    keys = list(keys)
    rows = values.select(*keys, F.nanvl(F.col(p), F.lit(None).cast("double")).alias(p))
    counts, n = cut_counted(rows.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    steps = running(counts, keys, [p], {"_cum": "_n"}, n)
    steps = join_on(steps, totals, keys) if keys else attach_one(steps, totals)
    steps = cut(steps.select(*keys, p, "_cum", (F.col(p) * F.col("_m") / F.col("_cum")).alias("_raw")))
    q = suffix_min(steps, keys, p, "_raw", out, n)
    return q.select(*keys, p, "_cum", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out))).alias(out))


def bh_counts(values: DataFrame, keys, p: str, cutoffs: dict) -> DataFrame:
    """Per group: rows (n_rows) and, per entry of cutoffs (new column -> cutoff), those with Benjamini-Hochberg q up to it.

    These are the rows up to the last p with p * m / rank <= cutoff. As p is never above that, larger ones need no rank.
    """
    keys = list(keys)
    rows = values.select(*keys, F.nanvl(F.col(p), F.lit(None).cast("double")).alias(p))
    counts = cut(rows.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n")))
    sizes = cut(counts.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col(p).isNotNull(), F.col("_n"))), F.lit(0)).alias("_m")))
    low, n = cut_counted(counts.where(F.col(p) <= max(cutoffs.values()) * (1 + 1e-9)))
    steps = join_on(running(low, keys, [p], {"_cum": "_n"}, n), sizes.select(*keys, "_m"), keys)
    raw = F.col(p) * F.col("_m") / F.col("_cum")
    found = steps.groupBy(*keys).agg(*[F.max(F.when(raw <= c, F.col("_cum"))).alias(name) for name, c in cutoffs.items()])
    return join_on(sizes.drop("_m"), found, keys, "left").na.fill(0, list(cutoffs))


def suffix_min(df: DataFrame, keys, order: str, value: str, out: str,
               probe: DataFrame | int | None = None) -> DataFrame:
    """min(value) over rows at or after this one in ascending `order` (unique per group)."""
    keys = list(keys)
    rows, groups, parts = split_hot(df, keys, [(order, True)], probe)
    group = keys + (["_part"] if groups else [])
    w = Window.partitionBy(*group).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    if not groups:
        return rows.withColumn(out, F.min(value).over(w))
    w_after = Window.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    mins = rows.where("_hot").groupBy(*group).agg(F.min(value).alias("_m0"))
    after = mins.select(*group, F.min("_m0").over(w_after).alias("_rest"))
    if groups * parts <= broadcast_rows(df.sparkSession):
        after = F.broadcast(after)
    rows = join_on(rows, after, group, "left")
    return rows.withColumn(out, F.least(F.min(value).over(w), F.col("_rest"))).drop("_part", "_hot", "_rest")


def top_rows(df: DataFrame, keys, order_cols, n: int, out: str = "rank") -> DataFrame:
    """First n rows per group; Spark prunes to n per map task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
