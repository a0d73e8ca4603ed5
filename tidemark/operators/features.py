"""Confidence scores from feature vectors: parameters are fitted as distributed aggregates, rows are scored in place.

Element-wise scores are native column expressions over a one-row parameter table; scores with d x d matrices or
reference sets run as numpy on Arrow batches. `semantics="reference"` keeps the definitions as published in code,
`"paper"` as published in print, where the two differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators import gram

#: Rows of a reference set that a task holds at once; larger sets are taken part by part.
REFERENCE_ROWS = 200_000
#: Rows of refs and of df, at most, in a cell of knn_classify (about 35 MB each at 64 dimensions), and those whose cosines a task holds at once.
CELL_ROWS, QUERY_ROWS, STEP_ROWS = 65_536, 65_536, 512
#: Cells that knn_classify makes, unless they would get fewer rows of df than LEAST_ROWS.
CELLS, LEAST_ROWS = 24, 8_192


def l1norm(x: Column) -> Column:
    return -vec.l1(x)


def maxcosine(x: Column, mus: Column) -> Column:
    n = vec.l2(x)
    return F.array_max(F.transform(mus, lambda m: vec.dot(x, m) / (n * vec.l2(m) + 1e-7)))


def projection(x: Column, mus: Column, p: Column) -> Column:
    """sum_c p_c |x| cos(x, mu_c)."""
    return vec.total(F.zip_with(mus, p, lambda m, q: q * vec.dot(x, m) / vec.l2(m)))


def react_threshold(fit: DataFrame, p: float = 0.9, x: str = "x") -> float:
    """The exact p-quantile of all activations of the fit rows (linear interpolation)."""
    return fit.select(F.explode(x).alias("v")).agg(F.percentile("v", F.lit(p))).first()[0]


def clipped(x: Column, threshold: float) -> Column:
    return F.transform(x, lambda v: F.least(v, F.lit(threshold)))


def dice_weights(w: Column, p: float = 0.7) -> Column:
    """Each class's weights above its k-th largest, k = int(d (1 - p)); the others are 0. Strict, so k - 1 stay."""

    def keep(row: Column) -> Column:
        k = F.floor(F.size(row) * F.lit(1 - p) + 1e-9).cast("int")
        bound = F.element_at(F.sort_array(row, asc=False), k)
        return F.transform(row, lambda v: F.when(v > bound, v).otherwise(0.0))

    return F.transform(w, keep)


def igeood_features_fit(fit: DataFrame) -> DataFrame:
    """One row (mus, sigma): class means, and the pooled within-class standard deviation of each dimension."""
    long = fit.select("label", F.posexplode("x").alias("pos", "v"))
    per = long.groupBy("label", "pos").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("s"))
    mus = per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("r")).select(F.struct("label", F.transform("r", lambda q: q["m"]).alias("mu")).alias("q")).agg(F.array_sort(F.collect_list("q")).alias("q")).select(F.transform("q", lambda q: q["mu"]).alias("mus"))
    sigma = per.groupBy("pos").agg(F.sqrt(F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("s")).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("r")).select(F.transform("r", lambda q: q["s"]).alias("sigma"))
    return mus.crossJoin(sigma)


def igeood_features(x: Column, mus: Column, sigma: Column, eps: float = 1e-6) -> Column:
    """Least Fisher-Rao distance between univariate Gaussians at x and at the class means, over the classes."""

    def distance(mu: Column) -> Column:
        def term(d: Column, s: Column) -> Column:
            a, b = F.sqrt(d * d + 2 * (s + s) * (s + s)), F.sqrt(d * d)
            r = F.sqrt(F.lit(2.0)) * F.ln((a + b + eps) / (a - b + eps))
            return r * r

        return F.sqrt(vec.total(F.zip_with(F.zip_with(x, mu, lambda u, v: u - v), sigma, term)))

    return F.array_min(F.transform(mus, distance))


# ---------------------------------------------------------------- nearest neighbours


def _knn_block(q: np.ndarray, refs: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The k best similarities of each row, best first."""
    out = np.full((len(q), k), -np.inf)
    for a in range(0, len(refs), 8192):
        s = q @ refs[a : a + 8192].T
        merged = np.concatenate([out, s], axis=1)
        out = -np.sort(-np.partition(merged, -k, axis=1)[:, -k:], axis=1)
    return out


def _rows_of(table) -> np.ndarray:
    """The x column of an Arrow table as a matrix, without a Python object for each number."""
    x = table["x"].combine_chunks()
    return np.asarray(x.flatten(), np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 1))


def _packed(rows: DataFrame) -> np.ndarray:
    return _rows_of(rows.select("x").toArrow())


def knn(df: DataFrame, refs: DataFrame, method: str = "knn_euclides", k: int = 10, avg_topk: bool = False, alpha: float = 1.0, seed: str = "knn", reference_rows: int = REFERENCE_ROWS) -> DataFrame:
    """df (id, x, ...) with `score`: the k-th (or mean of the k) nearest rows of refs (id, x), exactly.

    knn_euclides: minus the squared distance of unit vectors; knn_cosine: cosine; knn_projection: <x, r/|r|>.
    alpha < 1 keeps the share of refs with the least md5 of (seed, id). Reference rows are held part by part, never more
    than `reference_rows` a task on average; each part gives its k best, which are merged.
    """
    if alpha < 1:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
        refs = refs.where(u < alpha)
    n = refs.count()
    parts = max(1, -(-n // reference_rows))
    unit = method != "knn_projection"
    base, found = df.select("id", "domain", "x") if "domain" in df.columns else df.select("id", "x"), None
    keys = [c for c in base.columns if c != "x"]
    for part in range(parts):
        rows = refs if parts == 1 else refs.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        r = _packed(rows)
        shared = df.sparkSession.sparkContext.broadcast(r / np.linalg.norm(r, axis=1, keepdims=True))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                q = gram.matrix(pdf["x"])
                if len(q) and unit:
                    q = q / np.linalg.norm(q, axis=1, keepdims=True)
                yield pdf[keys].assign(best=list(_knn_block(q, shared.value, k, method)) if len(q) else [])

        schema = ", ".join(f"{c} {t}" for c, t in base.dtypes if c != "x") + ", best array<double>"
        got = base.mapInPandas(run, schema)
        found = got if found is None else found.unionByName(got)
    if parts > 1:
        found = found.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best"))
    top = F.filter("best", lambda v: v > float("-inf"))
    value = vec.total(top) / F.size(top) if avg_topk else F.element_at(top, -1)
    if method == "knn_euclides":
        value = -(2.0 - 2.0 * value)
    return found.select(*keys, value.alias("score"))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the positions, so that equal rows give equal products anywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _single(unit: np.ndarray) -> np.ndarray:
    """Unit rows in single precision; rows that are not of length 1 (of zeros, NaN or beyond the range of squares) are NaN."""
    with np.errstate(invalid="ignore", over="ignore"):
        out = unit.astype(np.float32)
        out[~(np.abs(np.einsum("ij,ij->i", unit, unit) - 1) < 1e-9)] = np.nan
    return out


def _nearest(q: np.ndarray, refs: np.ndarray, label: np.ndarray, k: int, single: np.ndarray | None = None, block: int = 8192, pairs: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, cosine, label) of each row's k nearest unit rows in refs: the larger cosine first, then the larger label; NaN is largest.

    A matrix product in single precision leaves out the rows that are surely beyond the k nearest found so far; the
    cosines of the others are summed in a fixed order. single: _single(refs), if it is there already.
    """
    norms = np.sqrt(_dots(q, q))
    with np.errstate(invalid="ignore", divide="ignore"):
        fast = _single(q / norms[:, None])
    single = _single(refs) if single is None else single
    # of a product: d roundings of sums and 3 of terms, each of 2^-24 of at most 1, and twice that to be sure
    slack = np.float32((q.shape[1] + 4) * 2.0**-23)
    row, s, lab = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, label.dtype)
    bound = np.full(len(q), -np.inf)  # a cosine that k rows reach
    a, size = 0, block // 8
    while a < len(refs):
        part = refs[a : a + size]
        near = fast @ single[a : a + size].T
        beyond = near < (bound - 2 * slack).astype(np.float32)[:, None]  # never true of NaN
        if beyond.size - np.count_nonzero(beyond) > 8 * k * len(q) and len(part) > k:
            least = np.partition(np.where(np.isnan(near), np.float32(np.inf), near), -k, axis=1)[:, -k]
            bound = np.maximum(bound, np.where(np.isinf(least), -np.inf, least.astype(np.float64) - slack))
            beyond = near < (bound - 2 * slack).astype(np.float32)[:, None]
        found = np.flatnonzero(~beyond)
        for c in range(0, len(found), pairs):
            r, j = np.divmod(found[c : c + pairs], len(part))
            with np.errstate(invalid="ignore", divide="ignore"):
                row, s, lab = np.concatenate([row, r]), np.concatenate([s, _dots(q[r], part[j]) / norms[r]]), np.concatenate([lab, label[a + j]])
            order = np.lexsort((-lab.astype(np.int64), -np.where(np.isnan(s), np.inf, s), row))
            row, s, lab = row[order], s[order], lab[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, s, lab = row[keep], s[keep], lab[keep]
        last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        bound[row[last]] = np.fmax(bound[row[last]], s[last])
        a, size = a + size, min(block, 2 * size)
    return row, s, lab


def knn_classify(df: DataFrame, refs: DataFrame, k: int = 20, temperature: float = 0.07, reference_rows: int = CELL_ROWS) -> DataFrame:
    """(id, domain if there, pred): the label with the most weight exp(cosine / temperature) among the k nearest rows of refs (id, x, label).

    Of equally near rows those of larger labels count first. Parts of refs and of df meet in cells on the executors, about
    `reference_rows` by QUERY_ROWS rows each at most; nothing passes through the driver.
    """
    keys = [c for c in ("id", "domain") if c in df.columns]
    parts, n = max(1, -(-refs.count() // reference_rows)), df.count()
    groups = max(1, -(-n // QUERY_ROWS), min(-(-CELLS // parts), n // LEAST_ROWS))

    def cell(part, group):
        return (part * groups + group).cast("int").alias("_cell")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = refs.select("x", F.col("label").cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part"), every(groups).alias("_group"))
    asked = df.select(*keys, "x", F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), every(parts).alias("_part"))
    # more partitions than cells, so that few of them share a task
    held, asked = (rows.select(*[c for c in rows.columns if c not in ("_part", "_group")], cell(F.col("_part"), F.col("_group"))).repartition(2 * parts * groups, "_cell") for rows in (held, asked))

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        r, q, label = _rows_of(held), _rows_of(asked), np.asarray(held["label"].combine_chunks(), np.int32)
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = r / np.sqrt(_dots(r, r))[:, None]
        del held, r
        single = _single(unit)
        found = [_nearest(q[a : a + STEP_ROWS], unit, label, k, single) for a in range(0, len(q) if len(unit) else 0, STEP_ROWS)]
        counts = [np.bincount(row, minlength=min(STEP_ROWS, len(q) - i * STEP_ROWS)) for i, (row, _, _) in enumerate(found)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if found else np.zeros(len(q) + 1)
        s, lab = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
        best = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s), pa.array(lab.astype(np.int32))], ["s", "label"]))
        return asked.select(keys).append_column("best", best)

    schema = ", ".join(f"{c} {t}" for c, t in df.select(*keys).dtypes) + ", best array<struct<s:double,label:int>>"
    found = held.groupBy("_cell").cogroup(asked.groupBy("_cell")).applyInArrow(run, schema)
    votes = found.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, k).alias("best")).select(*keys, F.explode("best").alias("b"))
    weights = votes.groupBy(*keys, F.col("b.label").alias("label")).agg(F.sum(F.exp(F.col("b.s") / temperature)).alias("w"))
    return weights.groupBy(*keys).agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("pred"))


def csi(df: DataFrame, refs: DataFrame) -> DataFrame:
    """|x| max_j cos(x, r_j) over all fit rows: the nearest one."""
    return knn(df, refs, "knn_projection", 1)


def csi_aligned(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """`reference` form, for equally long aligned sets: the denominator pairs row i of x with row i of the references."""
    if len(x) != len(refs) and 1 not in (len(x), len(refs)):
        raise ValueError("aligned sets only")
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    den = norms * np.linalg.norm(refs, axis=1, keepdims=True)
    return (norms[:, 0]) * (x @ refs.T / (den + 1e-7)).max(1)


# ---------------------------------------------------------------- matrix methods


def _nan_to(v: np.ndarray, value: float) -> np.ndarray:
    return np.where(np.isnan(v), value, v)


def _class_distances(x: np.ndarray, mus: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(mus)))
    with np.errstate(invalid="ignore"):
        for c, mu in enumerate(mus):
            d = x - mu
            out[:, c] = np.sqrt(np.einsum("ij,jk,ik->i", d, a, d))
    return out


def mahalanobis(df: DataFrame, fit: DataFrame, method: str = "EmpiricalCovariance", reg: float = 1e-6, semantics: str = "reference") -> DataFrame:
    """df with `score` = -min_c sqrt(d' A d); A is the triangular factor of the precision (reference) or the precision (paper)."""
    classes = gram.moments(fit, "label")
    mus, scatter, n = gram.pooled(classes)
    cov = gram.covariance(scatter, n, method, fit, {k: m.mean for k, m in classes.items()})
    if semantics == "reference":
        a = np.linalg.inv(np.linalg.cholesky(cov + reg * np.eye(len(cov)))).T
    else:
        a = np.linalg.inv(cov + reg * np.eye(len(cov)))
    # a NaN distance makes the minimum NaN
    return gram.map_matrix(df, lambda x: -_nan_to(_class_distances(x, mus, a).min(1), 1e6))


def relative_mahalanobis(df: DataFrame, fit: DataFrame, method: str = "EmpiricalCovariance") -> DataFrame:
    """df with `score` = -min_c (D_c - D_background), a difference of distances."""
    classes = gram.moments(fit, "label")
    mus, scatter, n = gram.pooled(classes)
    inv = np.linalg.pinv(gram.covariance(scatter, n, method, fit, {k: m.mean for k, m in classes.items()}))
    every = gram.Moments(sum(m.n for m in classes.values()), sum(m.s for m in classes.values()), sum(m.xx for m in classes.values()))
    background, binv = every.mean[None], np.linalg.pinv(every.scatter() / (every.n - 1))
    return gram.map_matrix(df, lambda x: -_nan_to((_class_distances(x, mus, inv) - _class_distances(x, background, binv)).min(1), 1e6))


def vim(df: DataFrame, fit: DataFrame, w: np.ndarray, b: np.ndarray, top_k: int | None = None) -> DataFrame:
    """df with `score` = energy - alpha |residual|: the part of x outside the principal space about u = -W^+ b.

    top_k: dimensions of the principal space; by default 1000 if d > 1500, else 512, which leaves an empty residual
    (and a constant score of 1e6) for d <= 512, as published. alpha comes from two passes of sums over the fit rows.
    """
    d = w.shape[1]
    top_k = (1000 if d > 1500 else 512) if top_k is None else top_k
    u = -np.linalg.pinv(w) @ b
    m = gram.moments(fit)[None]
    about = m.xx - np.outer(m.s, u) - np.outer(u, m.s) + m.n * np.outer(u, u)
    values, vectors = np.linalg.eigh(about / m.n)
    r = vectors[:, np.argsort(-values)[top_k:]]

    def top_logit(x: np.ndarray) -> np.ndarray:
        return (x @ w.T + b).max(1)

    def residual(x: np.ndarray) -> np.ndarray:
        return np.linalg.norm((x - u) @ r, axis=1)

    sums = gram.map_matrix(gram.map_matrix(fit.select("x"), top_logit, "t"), residual, "r").agg(F.avg("t"), F.avg("r")).first()
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = np.float64(sums[0]) / np.float64(sums[1])

    def score(x: np.ndarray) -> np.ndarray:
        z = x @ w.T + b
        top = z.max(1)
        with np.errstate(invalid="ignore"):
            return _nan_to(top + np.log(np.exp(z - top[:, None]).sum(1)) - alpha * residual(x), 1e6)

    return gram.map_matrix(df, score)


def kmeans(df: DataFrame, k: int, iterations: int = 300, seed: str = "kmeans") -> np.ndarray:
    """Lloyd iterations from the k rows with the least md5 of (seed, id): one job of partial sums each."""
    first = df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary")), "id").limit(k)
    centers = np.array([r.x for r in first.select("x").collect()])
    for _ in range(iterations):

        def nearest(x: np.ndarray, c=centers) -> np.ndarray:
            return ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)).argmin(1).astype(np.float64)

        got = gram.moments(gram.map_matrix(df.select("x"), nearest, "c").withColumn("c", F.col("c").cast("int")), "c")
        new = np.stack([got[i].mean if i in got else centers[i] for i in range(len(centers))])
        if np.allclose(new, centers, rtol=0, atol=1e-12):
            break
        centers = new
    return centers


def ssd(df: DataFrame, fit: DataFrame, k: int | None = None, iterations: int = 300, reg: float = 1e-8) -> DataFrame:
    """df with `score` = -min over k-means clusters of the Mahalanobis distance of the standardised unit vectors."""
    k = fit.select("label").distinct().count() if k is None else k
    unit = fit.withColumn("x", F.transform("x", lambda v: v / (vec.l2(F.col("x")) + 1e-10)))
    m = gram.moments(unit)[None]
    mean, std = m.mean, np.sqrt(np.diag(m.scatter()) / (m.n - 1))

    def standard(x: np.ndarray) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
        return (x - mean) / (std + 1e-10)

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(x=list(standard(gram.matrix(pdf["x"]))) if len(pdf) else [])

    rows = fit.select("id", "x").mapInPandas(mapped, "id long, x array<double>").persist()
    try:
        centers = kmeans(rows, k, iterations)

        def nearest(x: np.ndarray) -> np.ndarray:
            return ((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1)).argmin(1).astype(np.float64)

        got = gram.moments(gram.map_matrix(rows, nearest, "c").withColumn("c", F.col("c").cast("int")), "c")
    finally:
        rows.unpersist()
    parts = [(g.mean, np.linalg.pinv(g.scatter() / max(1.0, g.n - 1) + reg * np.eye(len(g.mean)))) for _, g in sorted(got.items())]
    return gram.map_matrix(df, lambda x: -_nan_to(np.column_stack([_class_distances(standard(x), mu[None], inv)[:, 0] for mu, inv in parts]).min(1), 1e6))


def rankfeat(x: np.ndarray) -> np.ndarray:
    """Feature maps (rows of matrices) without their first singular component."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    return x - s[..., :1, None] * u[..., :, :1] @ v[..., :1, :]
