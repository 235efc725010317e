"""Latent-space and population metrics over array columns."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepair.operators.neighbors import knn_join
from tidepair.operators.stats import safe_corr
from tidepair.plans.ordered import attach_one, quantiles

# fixed values: bandwidths of the kernel family, k = exp(-d2 / (2 bw))
MMD_BANDWIDTHS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def clean_weight(w: Column) -> Column:
    """NaN, infinite, null and negative weights count as 0."""
    v = w.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(F.greatest(v, F.lit(0.0)))


def knn_label_mixing(points: DataFrame, id_col: str, vec_col: str, label: str, k: int = 30) -> DataFrame:
    """Mean share of the k nearest neighbours with the own label, and its chance level sum(p^2)."""
    near = knn_join(points, [], id_col, vec_col, k)
    own = points.select(F.col(id_col), F.col(label).alias("_a"))
    other = points.select(F.col(id_col).alias("neighbor"), F.col(label).alias("_b"))
    same = near.join(own, id_col).join(other, "neighbor").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("same"))
    counts = points.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    chance = counts.agg((F.sum(F.col("_n").cast("double") * F.col("_n")) / (F.sum("_n") * F.sum("_n"))).alias("chance"))
    return attach_one(same, chance).withColumn("ratio", F.col("same") / F.greatest(F.col("chance"), F.lit(1e-8)))


def weighted_pair_mse(df: DataFrame, keys, pred: str, target: str, weight: str) -> DataFrame:
    """sum(w * mean_d(diff^2)) / (sum(w) + 1e-8), and the variant with cleaned, normalised weights."""
    per = squared_distance(F.col(pred), F.col(target)) / F.size(pred)
    rows = df.select(*keys, per.alias("_e"), F.col(weight).cast("double").alias("_raw"), clean_weight(F.col(weight)).alias("_w"))
    out = rows.groupBy(*keys).agg(
        (F.sum(F.col("_raw") * F.col("_e")) / (F.sum("_raw") + 1e-8)).alias("pair_mse"),
        F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_e")).alias("_we"), F.avg("_e").alias("_mean"))
    return out.withColumn("pair_mse_normalized", F.when(F.col("_s") <= 1e-8, F.col("_mean")).otherwise(
        F.col("_we") / F.nullif(F.col("_s"), F.lit(0.0)))).drop("_s", "_we", "_mean")


def paired_drift(df: DataFrame, keys, source: str, pred: str, target: str, weight: str) -> DataFrame:
    """Weighted MSE of the displacements from the source."""
    step = lambda z: F.zip_with(F.col(z), F.col(source), lambda x, s: x - s)
    moved = df.withColumn("_sp", step(pred)).withColumn("_st", step(target))
    return weighted_pair_mse(moved, keys, "_sp", "_st", weight).select(*keys, F.col("pair_mse_normalized").alias("loss_drift"))


def downhill(df: DataFrame, keys, residual: str, flow: str | None, weight: str) -> DataFrame:
    """Weighted mean of relu(-<residual, flow>); 0 where there is no flow column."""
    if flow is None:
        return df.select(*keys).distinct().withColumn("loss_down", F.lit(0.0))
    up = F.greatest(-dot(F.col(residual), F.col(flow)), F.lit(0.0))
    rows = df.select(*keys, up.alias("_u"), clean_weight(F.col(weight)).alias("_w"))
    return rows.groupBy(*keys).agg(F.when(F.sum("_w") <= 1e-8, F.avg("_u")).otherwise(
        F.sum(F.col("_w") * F.col("_u")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("loss_down"))


def _weights(w):
    w = np.maximum(np.nan_to_num(w.astype(float), nan=0.0, posinf=0.0, neginf=0.0), 0.0)
    return np.full(len(w), 1.0 / len(w)) if w.sum() <= 1e-8 else w / w.sum()


def _d2(a, b):
    return np.stack([((r - b) ** 2).sum(axis=1) for r in a])


def _per_batch(df, batch, pred, target, weight, fn, out):
    """fn over one training batch; a batch holds a fixed number of rows (make_batches), so a task is bounded."""
    kind = dict(df.dtypes)[batch]

    def one(pdf):
        p, t = np.stack(pdf["_p"].to_numpy()), np.stack(pdf["_t"].to_numpy())
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], out: [float(fn(p, t, _weights(pdf["_w"].to_numpy())))]})

    rows = df.select(batch, F.col(pred).alias("_p"), F.col(target).alias("_t"), F.col(weight).cast("double").alias("_w"))
    return rows.groupBy(batch).applyInPandas(one, f"`{batch}` {kind}, {out} double")


def rbf_mmd(df: DataFrame, batch: str, pred: str, target: str, weight: str, bandwidths=MMD_BANDWIDTHS) -> DataFrame:
    """Weighted multi-bandwidth MMD^2 per batch: prediction weighted, target uniform."""

    def mmd(p, t, w):
        u = np.full(len(t), 1.0 / len(t))
        xx, yy, xy = _d2(p, p), _d2(t, t), _d2(p, t)
        parts = [w @ np.exp(-xx / (2 * b)) @ w + u @ np.exp(-yy / (2 * b)) @ u - 2 * (w @ np.exp(-xy / (2 * b)) @ u) for b in bandwidths]
        return sum(parts) / max(len(parts), 1)

    return _per_batch(df, batch, pred, target, weight, mmd, "loss_mmd")


def sinkhorn_w2(df: DataFrame, batch: str, pred: str, target: str, weight: str, epsilon: float = 0.1, iterations: int = 100) -> DataFrame:
    """Entropic transport cost per batch, log-domain iterations on the batch's cost matrix."""

    def lse(m, axis):
        top = m.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(m - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    def w2(p, t, w):
        cost = _d2(p, t)
        log_a, log_b = np.log(w + 1e-8), np.full(len(t), np.log(1.0 / len(t) + 1e-8))
        u, v, kern = np.zeros(len(p)), np.zeros(len(t)), -cost / epsilon
        for _ in range(iterations):
            u = log_a - lse(kern + v[None, :], 1)
            v = log_b - lse(kern + u[:, None], 0)
        return (np.exp(kern + u[:, None] + v[None, :]) * cost).sum()

    return _per_batch(df, batch, pred, target, weight, w2, "loss_w2")


# fixed values: default weights of the population loss
LAMBDAS = {"loss_mmd": 1.0, "loss_w2": 1.0, "loss_drift": 1.0, "loss_down": 0.1}


def population_loss(df: DataFrame, batch: str, source: str, pred: str, target: str, weight: str, residual: str | None = None,
                    flow: str | None = None, lambdas=None, iterations: int = 100) -> DataFrame:
    """Weighted sum of the four terms per batch."""
    lam = {**LAMBDAS, **(lambdas or {})}
    out = rbf_mmd(df, batch, pred, target, weight).join(
        sinkhorn_w2(df, batch, pred, target, weight, iterations=iterations), batch).join(
        paired_drift(df, [batch], source, pred, target, weight), batch).join(
        downhill(df, [batch], residual, flow, weight), batch)
    total = sum((F.lit(v) * F.col(c) for c, v in lam.items()), F.lit(0.0))
    return out.withColumn("loss", total)


def masked_reconstruction(long: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Pooled MSE and per-cell Pearson over measured genes: long(cell_id, dataset_id, gene_id, pred, truth).

    A cell with a constant side has correlation 0.
    """
    rows = long.join(mask.distinct(), ["dataset_id", "gene_id"], "left_semi") if mask is not None else long
    err = (F.col("pred") - F.col("truth")) * (F.col("pred") - F.col("truth"))
    cell = rows.groupBy("cell_id").agg(
        F.sum(err).alias("_se"), F.count(F.lit(1)).alias("_n"), safe_corr("pred", "truth").alias("_r"))
    cell = cell.withColumn("pearson", F.coalesce("_r", F.lit(0.0)))
    base = cell.agg((F.sum("_se") / F.greatest(F.sum("_n"), F.lit(1))).alias("mse"), F.avg("pearson").alias("pearson_mean"),
                    F.count(F.lit(1)).alias("n_cells"))
    return attach_one(base, quantiles(cell, [], "pearson", {"pearson_median": 0.5}))


def masked_cell_mse(long: DataFrame, mask: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean error over measured genes per cell, then the weighted mean over cells; mean measured count.

    weights(cell_id, dataset_id, weight) lists every cell; a cell without measured genes has error 0.
    """
    rows = long.join(mask.distinct(), ["dataset_id", "gene_id"], "left_semi")
    err = (F.col("pred") - F.col("truth")) * (F.col("pred") - F.col("truth"))
    cell = rows.groupBy("cell_id").agg(F.avg(err).alias("_e"), F.count(F.lit(1)).alias("_n"))
    all_ = weights.join(cell, "cell_id", "left").na.fill(0, ["_e", "_n"]).withColumn("_w", F.greatest(F.col("weight"), F.lit(0.0)))
    return all_.agg((F.sum(F.col("_e") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-8))).alias("reconstruction"),
                    F.avg("_n").alias("mean_measured_genes"))


def latent_shift_features(df: DataFrame, x: str, y: str, z: str, z_pred: str) -> DataFrame:
    zero = F.transform(F.col(z), lambda v: F.lit(0.0))
    return (df.withColumn("predicted_delta_l2", F.sqrt(squared_distance(F.col(y), F.col(x))))
            .withColumn("latent_residual_l2", F.sqrt(squared_distance(F.col(z_pred), F.col(z))))
            .withColumn("source_latent_l2", F.sqrt(squared_distance(F.col(z), zero))))
