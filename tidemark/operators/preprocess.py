"""Score preprocessors (fit on one set, applied to another), feature reductions and contrastive losses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec


def _stats(fit: DataFrame, s: str, *aggs: Column) -> DataFrame:
    names = [f"a{i}" for i in range(len(aggs))]
    long = fit.select(F.posexplode(s).alias("pos", "v")).groupBy("pos").agg(*[a.alias(n) for a, n in zip(aggs, names)])
    return long.agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("r")).select(*[F.transform("r", vec.field(n)).alias(f"_{n}") for n in names])


def _one_if_zero(v: Column) -> Column:
    return F.when(v == 0, 1.0).otherwise(v)


def _affine(df: DataFrame, s: str, shift: Callable, scale: Callable, params: DataFrame) -> DataFrame:
    names = params.columns
    out = df.crossJoin(F.broadcast(params)).withColumn("_z", F.arrays_zip(F.col(s).alias("v"), *[F.col(n) for n in names]))
    return out.withColumn(s, F.transform("_z", lambda q: (q["v"] - shift(q)) / _one_if_zero(scale(q)))).drop("_z", *names)


def minmax(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    return _affine(df, s, lambda q: q["_a0"], lambda q: q["_a1"] - q["_a0"], _stats(fit, s, F.min("v"), F.max("v")))


def standard(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    return _affine(df, s, lambda q: q["_a0"], lambda q: q["_a1"], _stats(fit, s, F.avg("v"), F.stddev_pop("v")))


def robust(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    return _affine(df, s, lambda q: q["_a1"], lambda q: q["_a2"] - q["_a0"], _stats(fit, s, *[F.percentile("v", F.lit(q)) for q in (0.25, 0.5, 0.75)]))


def maxabs(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    return _affine(df, s, lambda q: F.lit(0.0), lambda q: q["_a0"], _stats(fit, s, F.max(F.abs("v"))))


def normalizer_l2(df: DataFrame, fit: DataFrame | None = None, s: str = "s") -> DataFrame:
    n = vec.l2(F.col(s))
    return df.withColumn(s, F.transform(s, lambda v: v / F.when(n == 0, 1.0).otherwise(n)))


def _array_matrix(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], s: str) -> DataFrame:
    names = df.columns

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{s: list(fn(np.array(pdf[s].tolist(), np.float64))) if len(pdf) else []})[names]

    return df.mapInPandas(run, df.schema)


def quantile_uniform(df: DataFrame, fit: DataFrame, s: str = "s", n: int = 1000) -> DataFrame:
    from tidemark.operators.aggregations import _quantile_grid, _uniform

    grid = _quantile_grid(fit, s, min(n, max(2, fit.count())))
    return _array_matrix(df, lambda x: _uniform(x, grid), s)


def power(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    from tidemark.operators.aggregations import power_fit, yeo_johnson

    params = power_fit(fit, s)
    return _array_matrix(df, lambda x: np.column_stack([(yeo_johnson(x[:, j].copy(), lam) - m) / (sd or 1.0) for j, (lam, m, sd) in enumerate(params)]), s)


PREPROCESSORS: dict[str, Callable[..., DataFrame]] = {"none": lambda df, fit=None, s="s": df, "minmax": minmax, "standard": standard, "robust": robust, "maxabs": maxabs, "normalizer_l2": normalizer_l2, "quantile_uniform": quantile_uniform, "power": power}

def register_preprocessing(name: str) -> Callable:
    """Registers fn(df, fit, s) -> df under a name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        PREPROCESSORS[name] = fn
        return fn

    return add


# ---------------------------------------------------------------- reductions of feature maps


def reduce_map(x: Column, how: str, rank: int) -> Column:
    """A feature map (nested arrays of `rank` levels) as one vector.

    flatten; avg, max: pool what is nested in each channel; getitem: the first token of rank 2; avg_or_getitem and
    max_or_getitem: pool rank 3, first token of rank 2; none. Vectors (rank 1) stay as they are.
    """
    if rank == 1 or how == "none":
        return x
    if how == "flatten":
        return F.flatten(x) if rank == 2 else F.flatten(F.flatten(x))
    if how == "getitem" or how.endswith("_or_getitem") and rank == 2:
        if rank != 2:
            raise ValueError("getitem takes the tokens of rank 2")
        return F.element_at(x, 1)
    flat = (lambda c: c) if rank == 2 else F.flatten
    if how.startswith("avg"):
        return F.transform(x, lambda c: vec.total(flat(c)) / F.size(flat(c)))
    if how.startswith("max"):
        return F.transform(x, lambda c: F.array_max(flat(c)))
    raise ValueError(f"unknown reduction {how}")


# ---------------------------------------------------------------- losses


def supcon_loss(features: np.ndarray, labels: np.ndarray | None = None, temperature: float = 0.07, base_temperature: float = 0.07, mode: str = "all") -> float:
    """Supervised contrastive loss of features [rows, views, d]; without labels each row is its own class."""
    if features.ndim < 3:
        raise ValueError("features need rows, views and dimensions")
    if mode not in ("all", "one"):
        raise ValueError(f"unknown mode {mode}")
    n, views = features.shape[:2]
    labels = np.arange(n) if labels is None else np.asarray(labels).reshape(-1)
    if len(labels) != n:
        raise ValueError("as many labels as rows are needed")
    every = features.reshape(n, views, -1).transpose(1, 0, 2).reshape(n * views, -1)
    anchors = every[:n] if mode == "one" else every
    logits = anchors @ every.T / temperature
    logits -= logits.max(1, keepdims=True)
    rows = np.arange(len(anchors))
    other = np.ones_like(logits)
    other[rows, rows] = 0
    positive = (np.tile(labels, len(anchors) // n)[:, None] == np.tile(labels, views)[None]) * other
    log_prob = logits - np.log((np.exp(logits) * other).sum(1, keepdims=True))
    per = (positive * log_prob).sum(1) / np.maximum(positive.sum(1), 1)
    return float(-(temperature / base_temperature) * per.mean())


def csi_loss(features: np.ndarray, shift_logits: np.ndarray, shift_labels: np.ndarray, labels: np.ndarray | None = None, weight: float = 1.0, **options) -> float:
    """Contrastive loss plus weight times the cross-entropy of the shift labels."""
    z = shift_logits - shift_logits.max(1, keepdims=True)
    ce = -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(z)), shift_labels].mean()
    return supcon_loss(features, labels, **options) + weight * float(ce)
