"""Moments and covariances: partial sums on the executors, small linear algebra on the driver.

What reaches the driver is one (count, sum, X'X) per class, d x d numbers whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Of one class: number of rows, sum of x, X'X, and the sum of |x|^4 about the class's first-pass origin."""

    n: float
    s: np.ndarray
    xx: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    def scatter(self) -> np.ndarray:
        return self.xx - np.outer(self.s, self.s) / self.n


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def moments(df: DataFrame, by: str | None = None, x: str = "x", weight: str | None = None) -> dict[object, Moments]:
    """Moments of `x` for each value of `by` (or of all rows, under None), optionally weighted."""
    keys = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = df.select(keys.alias("k"), F.col(x).alias("x"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list] = {}
        for pdf in batches:
            for k, part in pdf.groupby("k", dropna=False):
                k = None if pd.isna(k) else k
                m, w = matrix(part["x"]), part["w"].to_numpy()
                new = [w.sum(), w @ m, (m * w[:, None]).T @ m]
                held[k] = [a + b for a, b in zip(held[k], new)] if k in held else new
        if held:
            yield pd.DataFrame({"k": list(held), "n": [v[0] for v in held.values()], "s": [v[1].tolist() for v in held.values()], "xx": [v[2].ravel().tolist() for v in held.values()]})

    sums = rows.mapInPandas(partial, "k string, n double, s array<double>, xx array<double>")
    # partials of the tasks are summed element by element before anything is collected, in one pass over the rows
    flat = sums.select("k", F.size("s").alias("d"), F.posexplode(F.concat(F.array("n"), "s", "xx")).alias("p", "v"))
    flat = flat.groupBy("k", "p").agg(F.sum("v").alias("v"), F.max("d").alias("d")).groupBy("k").agg(F.max("d").alias("d"), F.array_sort(F.collect_list(F.struct("p", "v"))).alias("all"))
    got, sv, xv = {}, {}, {}
    for r in flat.collect():
        v = np.array([e.v for e in r["all"]])
        got[r.k], sv[r.k], xv[r.k] = float(v[0]), v[1 : 1 + r.d], v[1 + r.d :]
    kind = dict(df.dtypes).get(by) if by else None
    cast = int if kind in ("int", "bigint", "smallint") else (lambda v: v)
    return {(cast(k) if k is not None else None): Moments(n, sv[k], xv[k].reshape(len(sv[k]), -1)) for k, n in got.items()}


def pooled(classes: dict[object, Moments]) -> tuple[np.ndarray, np.ndarray, float]:
    """(class means in the order of the classes, pooled within-class scatter, rows)."""
    keys = sorted(classes)
    return np.stack([classes[k].mean for k in keys]), sum(classes[k].scatter() for k in keys), sum(classes[k].n for k in keys)


def covariance(scatter: np.ndarray, n: float, method: str = "EmpiricalCovariance", df: DataFrame | None = None, centers: dict | None = None, shrinkage: float = 0.1, alpha: float = 0.01) -> np.ndarray:
    """A covariance estimate from a scatter matrix; LedoitWolf and MinCovDet also look at the rows of df (label, x)."""
    d = len(scatter)
    s = scatter / n
    mu = np.trace(s) / d
    if method == "EmpiricalCovariance":
        return s
    if method == "ShrunkCovariance":
        return (1 - shrinkage) * s + shrinkage * mu * np.eye(d)
    if method == "OAS":
        a = (s**2).mean()
        top, low = a + mu**2, (n + 1) * (a - mu**2 / d)
        k = 1.0 if low == 0 else min(top / low, 1.0)
        return (1 - k) * s + k * mu * np.eye(d)
    if method == "LedoitWolf":
        fourth = _fourth_moment(df, centers)  # sum over rows of |x - center|^4
        delta = ((s - mu * np.eye(d)) ** 2).sum() / d
        beta = min((fourth / n - (s**2).sum()) / (n * d), delta)
        k = 0.0 if delta == 0 else max(0.0, beta) / delta
        return (1 - k) * s + k * mu * np.eye(d)
    if method == "GraphicalLasso":
        return graphical_lasso(s, alpha)
    if method == "GraphicalLassoCV":
        return graphical_lasso(s, _best_alpha(s, n))
    if method == "MinCovDet":
        return _min_cov_det(df, centers, d)
    raise ValueError(f"unknown covariance estimator {method}")


def _centered(df: DataFrame, centers: dict) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = matrix(pdf["x"])
            yield pd.DataFrame({"x": list(m - np.stack([shared.value[k] for k in pdf["label"]]))} if len(m) else {"x": []})

    return df.select("label", "x").mapInPandas(run, "x array<double>")


def _fourth_moment(df: DataFrame, centers: dict) -> float:
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return float(_centered(df, centers).agg(F.sum(square * square)).first()[0] or 0.0)


def graphical_lasso(s: np.ndarray, alpha: float, sweeps: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Block coordinate descent: each column solves a lasso against the rest."""
    d = len(s)
    w = s.copy() * 0.95
    np.fill_diagonal(w, np.diag(s))
    beta = np.zeros((d, d - 1)) if d > 1 else np.zeros((1, 0))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(d):
            rest = np.arange(d) != j
            v, u, b = w[np.ix_(rest, rest)], s[rest, j], beta[j]
            for _ in range(100):
                old = b.copy()
                for k in range(d - 1):
                    r = u[k] - v[k] @ b + v[k, k] * b[k]
                    b[k] = np.sign(r) * max(abs(r) - alpha, 0.0) / v[k, k]
                if np.abs(b - old).max(initial=0.0) < tol:
                    break
            w[rest, j] = w[j, rest] = v @ b
        if np.abs(w - before).mean() < tol * np.abs(s).mean():
            break
    return w


def _best_alpha(s: np.ndarray, n: float) -> float:
    """The penalty of a short path with the best penalised likelihood (BIC), in place of refits on folds of the rows."""
    top = np.abs(s - np.diag(np.diag(s))).max()
    best = (np.inf, 0.01)
    for a in np.geomspace(max(top * 0.02, 1e-6), max(top, 1e-6), 4):
        p = np.linalg.pinv(graphical_lasso(s, a, sweeps=20))
        edges = (np.abs(np.triu(p, 1)) > 1e-8).sum()
        best = min(best, (-n * (np.linalg.slogdet(p)[1] - np.trace(s @ p)) + edges * np.log(n), a))
    return best[1]


def _min_cov_det(df: DataFrame, centers: dict, d: int, steps: int = 10) -> np.ndarray:
    """Concentration steps: the half of the rows that is nearest by the current estimate gives the next one."""
    rows = _centered(df, centers).persist()
    m = moments(rows)[None]
    cov, mean = m.scatter() / m.n, m.mean
    try:
        for _ in range(steps):
            inv = np.linalg.pinv(cov)
            flat, center = [float(v) for v in inv.ravel()], [float(v) for v in mean]

            def distance(batches: Iterator[pd.DataFrame], inv=inv, mean=mean) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    x = matrix(pdf["x"]) - mean if len(pdf) else np.zeros((0, len(mean)))
                    yield pd.DataFrame({"x": pdf["x"], "d": np.einsum("ij,jk,ik->i", x, inv, x)})

            del flat, center
            scored = rows.mapInPandas(distance, "x array<double>, d double")
            median = scored.agg(F.percentile("d", F.lit(0.5))).first()[0]
            m = moments(scored.where(F.col("d") <= median))[None]
            new = m.scatter() / m.n
            if np.allclose(new, cov, rtol=1e-8, atol=1e-12):
                break
            cov, mean = new, m.mean
        return cov * max(1.0, median / d)  # consistency at the median, never below the raw estimate
    finally:
        rows.unpersist()


def reduction_matrix(cov: np.ndarray, method: str = "cholesky") -> np.ndarray:
    """A matrix L with L L' = cov^-1 (cholesky, svd), or the (pseudo-)inverse itself."""
    if method == "cholesky":
        return np.linalg.cholesky(np.linalg.inv(cov))
    if method == "svd":
        u, s, _ = np.linalg.svd(np.linalg.inv(cov))
        return u @ np.diag(np.sqrt(s))
    if method == "pinv":
        return np.linalg.pinv(cov)
    if method == "inv":
        return np.linalg.inv(cov)
    raise ValueError(f"unknown method {method}")


def map_matrix(df: DataFrame, fn, out: str = "score", x: str = "x") -> DataFrame:
    """df with a double column out = fn(matrix of the batch's x): Arrow batches, one numpy call each."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: fn(matrix(pdf[x])) if len(pdf) else np.zeros(0)})

    return df.mapInPandas(run, schema)
