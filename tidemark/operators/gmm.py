"""Gaussian mixtures by expectation-maximisation: one Spark job of weighted moments an iteration, densities in numpy.

The driver holds weights, means and covariances only. Initialisation `random_from_data`: the reference form gives every
row full responsibility for every component, so all components start, and stay, equal (EM stops at the third step);
the paper form starts from rows picked by a hash. `random` draws responsibilities from a hash. `kmeans` and
`k-means++` are not implemented by the definition and raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import gram


def covariances(kind: str, n: np.ndarray, s: np.ndarray, xx: np.ndarray, reg: float) -> np.ndarray:
    """Covariances of each component from weighted moments: full and tied add reg * trace to the diagonal, diag adds reg."""
    means = s / n[:, None]
    if kind == "tied":
        # all rows' second moment: the components' moments add up to it when responsibilities add up to 1
        cov = xx.sum(0) - (n[:, None] * means).T @ means
        cov = cov / n.sum()
        return cov + reg * np.trace(cov) * np.eye(len(cov))
    full = xx / n[:, None, None] - means[:, :, None] * means[:, None, :]
    if kind == "full":
        trace = np.trace(full, axis1=1, axis2=2)
        return full + reg * trace[:, None, None] * np.eye(full.shape[1])
    diag = np.diagonal(full, axis1=1, axis2=2) + reg
    if kind == "diag":
        return diag
    if kind == "spherical":
        return diag.mean(1)
    raise ValueError(f"unknown covariance type {kind}")


@dataclass
class Mixture:
    kind: str
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    converged: bool = False
    iterations: int = 0
    lower_bound: float = -np.inf

    def _full(self, k: int) -> np.ndarray:
        d = self.means.shape[1]
        if self.kind == "full":
            return self.covs[k]
        if self.kind == "tied":
            return self.covs
        if self.kind == "diag":
            return np.diag(self.covs[k])
        return self.covs[k] * np.eye(d)

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        """log w_k + log N_k(x), by a Cholesky factor of each precision."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            chol = np.linalg.cholesky(self._full(k))
            y = np.linalg.solve(chol, (x - self.means[k]).T)
            out[:, k] = np.log(w) - 0.5 * (d * np.log(2 * np.pi) + (y**2).sum(0)) - np.log(np.diag(chol)).sum()
        return out

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        lp = self.log_prob(x)
        m = lp.max(1)
        return m + np.log(np.exp(lp - m[:, None]).sum(1))

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        lp = self.log_prob(x)
        return np.exp(lp - self.score_samples(x)[:, None])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.log_prob(x).argmax(1)

    def n_parameters(self) -> int:
        k, d = self.means.shape
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}[self.kind]
        return int(cov + k * d + k - 1)

    def aic(self, mean_ll: float, n: int) -> float:
        return -2 * mean_ll * n + 2 * self.n_parameters()

    def bic(self, mean_ll: float, n: int) -> float:
        return -2 * mean_ll * n + self.n_parameters() * float(np.log(n))

    def sample(self, n: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        counts = rng.multinomial(n, self.weights / self.weights.sum())
        return np.concatenate([rng.multivariate_normal(self.means[k], self._full(k), c) for k, c in enumerate(counts)])


def require_fitted(model: Mixture | None) -> Mixture:
    if model is None or model.means is None:
        raise ValueError("the mixture is not fitted")
    return model


def _weighted(df: DataFrame, k: int, resp) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """(n, s, xx) of each component under responsibilities resp(x, ids) -> (r, log-likelihoods), summed by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ll, rows = None, 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = gram.matrix(pdf["x"])
            r, l = resp(x, pdf["id"].to_numpy())
            new = np.concatenate([np.concatenate([[r[:, j].sum()], r[:, j] @ x, ((x * r[:, j : j + 1]).T @ x).ravel()]) for j in range(k)])
            held = new if held is None else held + new
            ll, rows = ll + l.sum(), rows + len(x)
        if held is not None:
            yield pd.DataFrame({"v": [np.append(held, [ll, rows])]})

    sums = df.select("id", "x").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).orderBy("p").collect()
    v = np.array([r.v for r in sums])
    block = (len(v) - 2) // k
    d = int((-1 + np.sqrt(1 + 4 * (block - 1))) / 2)
    parts = v[:-2].reshape(k, block)
    return parts[:, 0], parts[:, 1 : 1 + d], parts[:, 1 + d :].reshape(k, d, d), v[-2], int(v[-1])


def fit(df: DataFrame, k: int, kind: str = "full", init: str = "random_from_data", semantics: str = "reference", max_iter: int = 100, tol: float = 1e-3, reg: float = 1e-6, seed: str = "gmm") -> Mixture:
    """A mixture of k components on df (id, x)."""
    if init in ("kmeans", "k-means++"):
        raise NotImplementedError(f"initialisation {init}")
    n_rows = df.count()
    if n_rows < k:
        raise ValueError(f"{n_rows} rows for {k} components")
    eps = 10 * np.finfo(np.float64).eps
    if init == "random_from_data" and semantics == "reference":

        def start(x, ids):
            return np.ones((len(x), k)), np.zeros(len(x))
    elif init == "random_from_data":
        picked = df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), "id").limit(k).select("x").collect()
        rows = np.array([r.x for r in picked])

        def start(x, ids):
            d = ((x[:, None, :] - rows[None]) ** 2).sum(2)
            return np.eye(k)[d.argmin(1)], np.zeros(len(x))
    elif init == "random":

        def start(x, ids):
            r = np.stack([np.random.default_rng(int(i) & 0x7FFFFFFF).random(k) for i in ids])
            return r / r.sum(1, keepdims=True), np.zeros(len(x))
    else:
        raise ValueError(f"unknown initialisation {init}")
    n, s, xx, _, _ = _weighted(df, k, start)
    n = n + eps
    if kind == "tied" and init == "random_from_data" and semantics == "reference":
        xx = xx / k  # one X'X, not one for each component
    model = Mixture(kind, np.ones(k) if init == "random_from_data" and semantics == "reference" else n / n_rows, s / n[:, None], covariances(kind, n, s, xx, reg))
    for i in range(1, max_iter + 1):

        def e_step(x, ids, m=model):
            return m.predict_proba(x), m.score_samples(x)

        n, s, xx, ll, _ = _weighted(df, k, e_step)
        n = n + eps
        bound = ll / n_rows
        new = Mixture(kind, n / n_rows, s / n[:, None], covariances(kind, n, s, xx, reg), False, i, bound)
        done = abs(bound - model.lower_bound) < tol
        model = new
        if done:
            model.converged = True
            break
    return model


def gmm(df: DataFrame, fit_rows: DataFrame, k: int | None = None, kind: str = "full", **options) -> DataFrame:
    """df with `score`: the log-density of a mixture fitted on fit_rows; k defaults to the number of classes."""
    k = fit_rows.select("label").distinct().count() if k is None else k
    model = fit(fit_rows, k, kind, **options)
    return gram.map_matrix(df, model.score_samples)
