"""Aggregations of a stack of layer scores `s` (array<double>, ordered by layer) to one score, and the p-value combiners.

Stateless ones are column expressions; fitted ones take a one-row parameter table of per-layer statistics, which a
single pre-aggregated job computes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import special, vec
from tidemark.sources.folders import shared_folder

# ---------------------------------------------------------------- stateless


def mean(s: Column) -> Column:
    return vec.total(s) / F.size(s)


def median(s: Column) -> Column:
    """The lower median: no averaging for an even number."""
    return vec.nan_guard(s, F.element_at(F.array_sort(s), F.floor((F.size(s) - 1) / 2).cast("int") + 1))


def largest(s: Column) -> Column:
    return F.array_max(s)


def least(s: Column) -> Column:
    return vec.nan_guard(s, F.array_min(s))


def avg_topk(s: Column, k: int = 2) -> Column:
    return vec.total(vec.largest(s, k)) / F.least(F.lit(k), F.size(s))


def topk(s: Column, k: int = 2) -> Column:
    """The k largest, as an array."""
    return vec.largest(s, k)


def layer_idx(s: Column, i: int = -1) -> Column:
    return F.element_at(s, i if i < 0 else i + 1)


def dws(s: Column) -> Column:
    """sum of s_l * l / L, so that layer 0 counts nothing."""
    return vec.total(F.transform(s, lambda v, i: v * i / F.size(s)))


STATELESS: dict[str, Callable[..., Column]] = {"none": lambda s: s, "mean": mean, "median": median, "max": largest, "min": least, "avg_topk": avg_topk, "topk": topk, "layer_idx": layer_idx, "dws": dws}

# ---------------------------------------------------------------- fitted


def layer_stats(fit: DataFrame, s: str = "s") -> DataFrame:
    """One row (l_avg, l_max, l_min): statistics of each layer."""
    long = fit.select(F.posexplode(s).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("a"), F.max("v").alias("x"), F.min("v").alias("n"))
    rows = long.agg(F.array_sort(F.collect_list(F.struct("pos", "a", "x", "n"))).alias("r"))
    return rows.select(*[F.transform("r", vec.field(f)).alias(name) for f, name in (("a", "l_avg"), ("x", "l_max"), ("n", "l_min"))])


def cosine(s: Column) -> Column:
    return vec.dot(s, F.col("l_avg")) / (vec.l2(s) * vec.l2(F.col("l_avg")))


def _inner(s: Column, by: str, integral: bool = False) -> Column:
    m, avg = F.col(by), F.col("l_avg")
    r = F.zip_with(avg, m, lambda a, b: a / b)
    terms = F.zip_with(F.zip_with(s, m, lambda a, b: a / b), r, lambda a, b: a * b)
    value = vec.total(terms)
    if integral:
        value = value - (F.element_at(terms, 1) + F.element_at(terms, -1)) / 2
    return value / vec.dot(r, r)


FITTED: dict[str, Callable[[Column], Column]] = {
    "cosine": cosine,
    "innerprod": lambda s: _inner(s, "l_max"),
    "innerprod_integral": lambda s: _inner(s, "l_max", True),
    "innerprod_mean": lambda s: _inner(s, "l_avg"),
    "innerprod_min": lambda s: _inner(s, "l_min"),
}


def register_aggregation(name: str) -> Callable:
    """Registers fn(df, fit, s) -> df with `score` (fitted or not) under a name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        NUMERIC[name] = fn
        return fn

    return add


def list_aggregations() -> list[str]:
    return sorted({*STATELESS, *FITTED, *NUMERIC})


def aggregate_stack(df: DataFrame, fit: DataFrame, name: str, s: str = "s") -> DataFrame:
    """df with `score` by the named aggregation."""
    if name in STATELESS:
        return df.withColumn("score", STATELESS[name](F.col(s)))
    if name in FITTED:
        return df.crossJoin(F.broadcast(layer_stats(fit, s))).withColumn("score", FITTED[name](F.col(s))).drop("l_avg", "l_max", "l_min")
    if name in NUMERIC:
        return NUMERIC[name](df, fit, s)
    raise ValueError(f"unknown aggregation {name}")


def _stack_matrix(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], s: str) -> DataFrame:
    from tidemark.operators.gram import map_matrix

    return map_matrix(df, fn, x=s)


def mahalanobis(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    """-sqrt((s - m)' pinv(cov) (s - m)), cov with N - 1."""
    from tidemark.operators.gram import moments

    m = moments(fit, x=s)[None]
    mean, inv = m.mean, np.linalg.pinv(m.scatter() / (m.n - 1))
    return _stack_matrix(df, lambda x: -np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x - mean, inv, x - mean), 0)), s)


def _quantile_grid(fit: DataFrame, s: str, n: int) -> np.ndarray:
    """[layer, n]: quantiles of each layer at equal steps."""
    steps = [float(q) for q in np.linspace(0, 1, n)]
    rows = fit.select(F.posexplode(s).alias("pos", "v")).groupBy("pos").agg(F.percentile("v", F.array(*[F.lit(q) for q in steps])).alias("q")).orderBy("pos").collect()
    return np.array([r.q for r in rows])


def _uniform(x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Interpolated ranks in the grid: the mean of those from either side, so that ties get their middle."""
    steps = np.linspace(0, 1, grid.shape[1])
    return np.column_stack([(np.interp(c, q, steps) - np.interp(-c, -q[::-1], -steps[::-1])) / 2 for c, q in zip(x.T, grid)])


def ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(p)


def quantile(df: DataFrame, fit: DataFrame, s: str = "s", n: int = 1000) -> DataFrame:
    """Each layer mapped to a normal by its quantiles, then the mean."""
    grid = _quantile_grid(fit, s, min(n, max(2, fit.count())))
    low = 1e-7
    return _stack_matrix(df, lambda x: ppf(np.clip(_uniform(x, grid), low, 1 - low)).mean(1), s)


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else (np.power(x[pos] + 1, lam) - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -(np.power(1 - x[~pos], 2 - lam) - 1) / (2 - lam)
    return out


def power_fit(fit: DataFrame, s: str, rounds: int = 5, grid: int = 41) -> list[tuple[float, float, float]]:
    """(lambda, mean, std) of each layer: the likelihood over a grid of lambdas that narrows, one job of sums a round."""
    layers = len(fit.select(s).first()[0])
    low, high = np.full(layers, -4.0), np.full(layers, 6.0)
    best = None
    for _ in range(rounds):
        lams = np.linspace(low, high, grid)  # [grid, layer]

        def sums(batches: Iterator[pd.DataFrame], lams=lams) -> Iterator[pd.DataFrame]:
            acc = np.zeros((layers, grid, 4))
            for pdf in batches:
                x = np.array(pdf[s].tolist(), np.float64) if len(pdf) else np.zeros((0, layers))
                for j in range(layers):
                    c = x[:, j]
                    for g in range(grid):
                        y = yeo_johnson(c, lams[g, j])
                        acc[j, g] += len(y), y.sum(), (y * y).sum(), (np.sign(c) * np.log1p(np.abs(c))).sum()
            yield pd.DataFrame({"v": [acc.ravel().tolist()]})

        rows = fit.select(s).mapInPandas(sums, "v array<double>").select(F.posexplode("v").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).orderBy("p").collect()
        acc = np.array([r.v for r in rows]).reshape(layers, grid, 4)
        n, m = acc[..., 0], acc[..., 1] / acc[..., 0]
        var = np.maximum(acc[..., 2] / n - m**2, 1e-300)
        ll = -n / 2 * np.log(var) + (lams.T - 1) * acc[..., 3]
        i = ll.argmax(1)
        pick = np.arange(layers)
        best = [(float(lams[i[j], j]), float(m[j, i[j]]), float(np.sqrt(var[j, i[j]]))) for j in pick]
        step = (high - low) / (grid - 1)
        center = lams[i, pick]
        low, high = center - step, center + step
    return best


def power(df: DataFrame, fit: DataFrame, s: str = "s") -> DataFrame:
    """Each layer made near-normal by a fitted Yeo-Johnson power and standardised, then the mean."""
    params = power_fit(fit, s)
    return _stack_matrix(df, lambda x: np.column_stack([(yeo_johnson(x[:, j].copy(), lam) - m) / (sd or 1.0) for j, (lam, m, sd) in enumerate(params)]).mean(1), s)


def _cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again: what is joined by value must not be computed twice."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _nearest(q: np.ndarray, ref: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of the n nearest rows of ref, nearest first, equal ones by place."""
    d = np.zeros((len(q), len(ref)))
    for j in range(ref.shape[1]):
        d += (q[:, j, None] - ref[None, :, j]) ** 2
    d = np.sqrt(d)
    n = min(n, len(ref))
    i = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    found = np.take_along_axis(d, i, 1)
    i = np.take_along_axis(i, np.argsort(found, axis=1, kind="stable"), 1)
    tied = (d <= found.max(1, keepdims=True)).sum(1) != n  # more rows at the last distance, or NaN
    if tied.any():
        i[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :n]
    return np.take_along_axis(d, i, 1), i


def _neighbours(base: DataFrame, ref: DataFrame, n: int, parts: int, own: bool) -> DataFrame:
    """(key, d, near, take): the n nearest fit rows of each row of base (key, s), as distinct rows `near` that count `take` times.

    ref (key, s, c) is held part by part; each part gives its n + 1 best distinct rows, which are merged. With own a row is
    not its own neighbour, but its copies are.
    """
    found = None
    for part in range(parts):
        got = ref.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).orderBy("key").toArrow()
        if not len(got):
            continue
        keys, counts = np.asarray(got["key"].to_pylist(), "S32"), np.asarray(got["c"])
        rows = np.asarray(got["s"].combine_chunks().flatten(), np.float64).reshape(len(got), -1)
        shared = base.sparkSession.sparkContext.broadcast((keys, counts, rows))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys, counts, rows = shared.value
            step = max(1, (1 << 21) // len(rows))
            for pdf in batches:
                for a in range(0, len(pdf), step):
                    block = pdf.iloc[a : a + step]
                    d, i = _nearest(np.array(block["s"].tolist(), np.float64), rows, n + 1)
                    yield pd.DataFrame({"key": block["key"], "best": [[{"d": float(x), "near": keys[y].decode(), "c": int(counts[y])} for x, y in zip(*r)] for r in zip(d, i)]})

        one = base.select("key", "s").mapInPandas(run, "key string, best array<struct<d double, near string, c bigint>>")
        found = one if found is None else found.unionByName(one)
    if parts > 1:
        found = found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, n + 1).alias("best"))
    if own:
        found = found.select("key", F.transform("best", lambda b: F.struct(b["d"].alias("d"), b["near"].alias("near"), (b["c"] - (b["near"] == F.col("key")).cast("long")).alias("c"))).alias("best"))
    before = lambda i: F.aggregate(F.slice("best", F.lit(1), i), F.lit(0).cast("long"), lambda t, b: t + b["c"])
    taken = F.transform("best", lambda b, i: F.struct(b["d"].alias("d"), b["near"].alias("near"), F.least(b["c"], F.lit(n) - before(i)).alias("take")))
    return found.select("key", F.explode(taken).alias("b")).select("key", "b.*").where("take > 0")


def lof(df: DataFrame, fit: DataFrame, s: str = "s", n: int = 20, rows: int = 50_000) -> DataFrame:
    """Minus the local outlier factor against all fit rows, exactly; about `rows` of them are held at a time.

    Copies have the same neighbours, so distinct rows are searched for and counted as often as they occur. Of rows at
    equal distance the first by md5 of the stack are taken.
    """
    key = F.md5(F.to_json(s).cast("binary"))
    ref = _cut(fit.groupBy(F.col(s).alias("s")).agg(F.count("*").alias("c")).select(F.md5(F.to_json("s").cast("binary")).alias("key"), "s", "c"))
    total, distinct = ref.agg(F.sum("c"), F.count("*")).first()
    n = min(n, (total or 0) - 1)
    if n < 1:
        raise ValueError("lof needs two fit rows at least")
    parts = max(1, -(-distinct // rows))

    near = _cut(_neighbours(ref, ref, n, parts, own=True))
    reach = near.groupBy("key").agg(F.max("d").alias("k_dist")).withColumnRenamed("key", "near")
    density = 1.0 / (F.sum(F.col("take") * F.greatest("d", "k_dist")) / n + 1e-10)
    local = _cut(near.join(reach, "near").groupBy("key").agg(density.alias("lrd")).withColumnRenamed("key", "near").join(reach, "near"))

    base = _cut(df.withColumn("_lof_key", key))
    queries = base.groupBy("_lof_key").agg(F.first(s).alias("s")).withColumnRenamed("_lof_key", "key")
    scores = _neighbours(queries, ref, n, parts, own=False).join(local, "near").groupBy(F.col("key").alias("_lof_key")).agg((-(F.sum(F.col("take") * F.col("lrd")) / n) / density).alias("score"))
    return base.join(scores, "_lof_key", "left").drop("_lof_key")


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_forest(df: DataFrame, fit: DataFrame, s: str = "s", trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """Minus the isolation score: trees on `sample` rows each, which is the method's own bound; rows are picked by md5."""
    ref = np.array([r[0] for r in fit.select(s).orderBy(F.md5(F.to_json(s).cast("binary")), F.to_json(s)).limit(trees * sample).collect()], np.float64)
    rng = np.random.default_rng(seed)
    sample = min(sample, len(ref))
    limit = int(np.ceil(np.log2(max(2, sample))))

    def grow(x: np.ndarray, depth: int):
        spread = x.max(0) - x.min(0) if len(x) else np.zeros(ref.shape[1])
        if depth >= limit or len(x) <= 1 or not spread.any():
            return _path(len(x)) + depth
        f = rng.choice(np.flatnonzero(spread))
        t = rng.uniform(x[:, f].min(), x[:, f].max())
        return f, t, grow(x[x[:, f] <= t], depth + 1), grow(x[x[:, f] > t], depth + 1)

    forest = [grow(ref[rng.choice(len(ref), sample, replace=False)], 0) for _ in range(trees)]

    def length(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, low, high = tree
        out, left = np.empty(len(x)), x[:, f] <= t
        out[left], out[~left] = length(low, x[left]), length(high, x[~left])
        return out

    scale = _path(sample) or 1.0
    return _stack_matrix(df, lambda x: -np.power(2.0, -np.mean([length(t, x) for t in forest], axis=0) / scale), s)


NUMERIC = {"mahalanobis": mahalanobis, "quantile": quantile, "power": power, "lof": lof, "if": isolation_forest}

# ---------------------------------------------------------------- p-values


def p_values(df: DataFrame, ref: DataFrame, s: str = "s", floor: float = 1e-8, key: str = "id") -> DataFrame:
    """df with `p` array<double>: each layer's score in the empirical distribution of ref, linearly interpolated.

    The sorted reference gets an end point below and above (its extreme times or over n, away from the data) and heights
    i / (n + 2); outside it is clamped. Reference and test values of a layer are merged in one sorted window, so neither
    side is collected; sorted runs are cut at reference quantiles, and counts before a run come from its pre-aggregate.
    """
    n = ref.count()
    r = ref.select(F.posexplode(s).alias("layer", "v"))
    ends = r.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ends = ends.select("layer", F.explode(F.array(F.col("lo") * F.when(F.col("lo") > 0, 1.0 / n).otherwise(float(n)), F.col("hi") * F.when(F.col("hi") > 0, float(n)).otherwise(1.0 / n))).alias("v"))
    grid = r.unionByName(ends).groupBy("layer", "v").agg(F.count("*").alias("c"))
    t = df.select(F.col(key).alias("k"), F.posexplode(s).alias("layer", "v"))
    # runs between quantiles of the reference keep a layer from being one task's work
    cuts = grid.groupBy("layer").agg(F.percentile_approx("v", F.array(*[F.lit(i / 16) for i in range(1, 16)]), 1000).alias("cuts"))

    def cut(x: DataFrame) -> DataFrame:
        return x.join(F.broadcast(cuts), "layer").withColumn("run", F.size(F.filter("cuts", lambda c: c <= F.col("v")))).drop("cuts")

    grid, t = cut(grid), cut(t)
    runs = grid.groupBy("layer", "run").agg(F.sum("c").alias("cs"), F.min("v").alias("first"), F.max("v").alias("last"))
    before, after = Window.partitionBy("layer").orderBy("run").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("layer").orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    every = F.broadcast(cuts.select("layer", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("run")))
    runs = every.join(runs, ["layer", "run"], "left").select("layer", "run", F.coalesce(F.sum("cs").over(before), F.lit(0)).alias("base"), F.max("last").over(before).alias("prev"), F.min("first").over(after).alias("succ"))
    both = grid.select("layer", "run", "v", "c", F.lit(None).cast(df.schema[key].dataType).alias("k")).unionByName(t.select("layer", "run", "v", F.lit(0).cast("long").alias("c"), "k"))
    up = Window.partitionBy("layer", "run").orderBy(F.col("v"), F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("layer", "run").orderBy(F.col("v"), F.col("k").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    here = F.when(F.col("k").isNull(), F.col("v"))
    m = both.withColumn("j", F.sum("c").over(up)).withColumn("low", F.max(here).over(up)).withColumn("high", F.min(here).over(down)).where("k is not null").join(F.broadcast(runs), ["layer", "run"])
    j, low, high = F.col("j") + F.col("base"), F.coalesce("low", "prev"), F.coalesce("high", "succ")
    share = F.when(low.isNull(), F.lit(1.0)).when(high.isNull(), F.lit(n + 2.0)).otherwise(j + (F.col("v") - low) / (high - low))
    p = F.greatest(F.lit(floor), share / F.lit(n + 2.0))
    out = m.select("k", "layer", p.alias("p")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("layer", "p"))).alias("r")).select(F.col("k").alias(key), F.transform("r", lambda q: q["p"]).alias("p"))
    return df.join(out, key)


def _logs(p: Column) -> Column:
    return vec.total(F.transform(p, lambda v: F.ln(v)))


def fisher(p: Column) -> Column:
    return -2.0 * _logs(p)


def stouffer(p: Column) -> Column:
    return vec.total(F.transform(p, special.normal_ppf)) / F.sqrt(F.size(p).cast("double"))


def tippet(p: Column) -> Column:
    return F.array_min(p)


def wilkinson(p: Column) -> Column:
    return F.array_max(p)


def edgington(p: Column) -> Column:
    return vec.total(p)


def pearson(p: Column) -> Column:
    return 2.0 * vec.total(F.transform(p, lambda v: F.ln(1 - v + 1e-6)))


def simes(p: Column) -> Column:
    return F.array_min(F.transform(F.array_sort(p), lambda v, i: v * F.size(p) / (i + 1)))


def geometric_mean(p: Column) -> Column:
    return F.pow(F.aggregate(p, F.lit(1.0), lambda a, v: a * v), 1.0 / F.size(p))


def rho(p: Column) -> Column:
    phi = F.transform(p, special.normal_ppf)
    k = F.size(p)
    m = vec.total(phi) / k
    return 1 - vec.total(F.transform(phi, lambda v: (v - m) * (v - m))) / (k - 1)


def hartung(p: Column, r: float) -> Column:
    k = F.size(p).cast("double")
    return vec.total(F.transform(p, special.normal_ppf)) / F.sqrt((1 - r) * k + r * k * k)


def fisher_group(p: Column, m: int) -> Column:
    """The p-value of Fisher's statistic: the chi-square distribution with 2m degrees of freedom."""
    return special.chi2_cdf_even(fisher(p), m)


def stouffer_group(p: Column) -> Column:
    return special.normal_cdf(stouffer(p))


COMBINERS: dict[str, Callable[[Column], Column]] = {"fisher": fisher, "stouffer": stouffer, "tippet": tippet, "wilkinson": wilkinson, "edgington": edgington, "pearson": pearson, "simes": simes, "geometric_mean": geometric_mean}


def combiner(name: str) -> Callable[[Column], Column]:
    try:
        return COMBINERS[name.lower()]
    except KeyError:
        raise NotImplementedError(f"combiner {name}") from None
