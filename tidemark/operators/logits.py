"""Confidence scores from logits: stateless projections, and two with fitted class parameters.

Every score is a native column expression of the logits `z` (and, where a linear head is perturbed, of `x` and `w`);
dropout passes over rows of one head are numpy on Arrow batches.
Higher means more in distribution, but for `entropy`, whose sign is kept as its definition has it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vec


def always(value: float) -> Column:
    return F.lit(float(value))


def random_score(seed: int = 0) -> Column:
    return F.rand(seed)


def msp(z: Column) -> Column:
    """The largest softmax probability."""
    m = F.array_max(z)
    return 1.0 / F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - m))


def max_logits(z: Column) -> Column:
    return F.array_max(z)


def argm(z: Column) -> Column:
    return vec.argmax(z).cast("double")


def entropy(z: Column) -> Column:
    return vec.lse(z) - vec.dot(vec.softmax(z), z)


def energy(z: Column, temperature: float = 1.0) -> Column:
    return temperature * vec.lse(vec.scaled(z, 1.0 / temperature))


def odin(z: Column, temperature: float = 1000.0) -> Column:
    return msp(vec.scaled(z, 1.0 / temperature))


def doctor(z: Column, temperature: float = 1.0) -> Column:
    p = vec.softmax(vec.scaled(z, 1.0 / temperature))
    return vec.dot(p, p) - 1.0


def gradnorm(z: Column, x: Column, temperature: float = 1.0) -> Column:
    """L1 norm of the head gradient of the summed negative log-probabilities, in closed form: an outer product."""
    p = vec.softmax(vec.scaled(z, 1.0 / temperature))
    c = F.size(z).cast("double")
    return vec.l1(x) * F.aggregate(p, F.lit(0.0), lambda s, v: s + F.abs(v * c - 1.0)) / temperature


def perturbed(x: Column, z: Column, w: Column, method: str, eps: float, temperature: float) -> Column:
    """x moved by eps along the sign of the score's gradient, for a linear head."""
    if method == "odin":
        direction = F.element_at(w, vec.argmax(z) + 1)
    else:
        p = vec.softmax(vec.scaled(z, 1.0 / temperature))
        if method == "energy":
            dz = p
        elif method == "doctor":
            dz = F.transform(p, lambda q: 2.0 * (q * q - q * vec.dot(p, p)) / temperature)
        else:
            raise ValueError(f"no gradient for {method}")
        direction = vec.combine_rows(w, dz, F.size(x))
    return F.zip_with(x, direction, lambda a, g: a + eps * F.signum(g))


def _digest(seed: str, k: int):
    return lambda j: F.md5(F.concat_ws(":", F.lit(seed), F.lit(str(k)), j.cast("string"), F.col("id").cast("string")).cast("binary"))


def mcdropout(df: DataFrame, passes: int = 5, seed: str = "drop", semantics: str = "reference", head: DataFrame | None = None) -> DataFrame:
    """df with `score`: softmax averaged over dropout passes of the features, then its maximum.

    Masks are md5 bits of (seed, pass, id): half of the features go, the rest doubles. reference: the first pass counts
    twice in the sum, which is still divided by the number of passes; paper: a plain mean. head: one row (w, b) for all
    rows, which are then scored as matrix products on Arrow batches; without it w and b are columns, of each row its own.
    """
    weights = [2.0 if k == 0 and semantics == "reference" else 1.0 for k in range(passes)]
    if head is not None:
        return df.withColumn("score", _mcdropout_by_batch(head, weights, seed)(F.col("id").cast("string"), F.col("x")))

    def one(k: int) -> Column:
        # enough hexadecimal digits for every feature: one more digest for each 32
        digests = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 32).cast("int")), _digest(seed, k))
        kept = vec.bound(F.array_join(digests, ""), lambda d: F.transform("x", lambda v, i: F.when(d.substr(i + 1, F.lit(1)) >= "8", v * 2.0).otherwise(0.0)))
        return vec.softmax(vec.bound(kept, lambda x: vec.matvec(F.col("w"), x, F.col("b"))))

    mean = vec.scaled(one(0), weights[0] / passes)
    for k in range(1, passes):
        mean = vec.plus(mean, vec.scaled(one(k), weights[k] / passes))
    return df.withColumn("score", F.array_max(mean))


def _mcdropout_by_batch(head: DataFrame, weights: list[float], seed: str, step: int = 1 << 18):
    """A function of (id as string, x): the score, or null where x, the head or a feature that a pass keeps is null, or x has another length."""
    first = head.select("w", "b").first()
    w, b = (first.w, first.b) if first else (None, None)
    whole = bool(w) and b is not None and len(b) == len(w) and None not in b and all(r is not None and len(r) == len(w[0]) > 0 and None not in r for r in w)
    shared = head.sparkSession.sparkContext.broadcast((np.array(w, np.float64), np.array(b, np.float64)) if whole else None)

    def masks(names: list[str], k: int, d: int) -> np.ndarray:
        """Whether the hexadecimal digit of each feature is 8 at least."""
        digests = b"".join(hashlib.md5(f"{seed}:{k}:{j}{n}".encode(), usedforsecurity=False).digest() for n in names for j in range(-(-d // 32)))
        return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(names), -1), axis=1)[:, ::4][:, :d].astype(bool)

    def scores(ids: pa.Array, x: pa.Array) -> pa.Array:
        out, null = np.zeros(len(x)), np.ones(len(x), bool)
        if shared.value is not None and len(x):
            w, b = shared.value
            d = w.shape[1]
            at = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(x), d), False)))
            names = ["" if n is None else f":{n}" for n in ids.take(pa.array(at)).to_pylist()]  # as concat_ws, which leaves out nulls
            for a in range(0, len(at), max(1, step // d)):
                i = at[a : a + max(1, step // d)]
                flat = x.take(pa.array(i)).flatten()
                missing = np.asarray(flat.is_null()).reshape(-1, d) if flat.null_count else None
                rows, mean, lost = np.asarray(flat, np.float64).reshape(-1, d), 0.0, np.zeros(len(i), bool)
                for k, weight in enumerate(weights):
                    on = masks(names[a : a + len(i)], k, d)
                    if missing is not None:
                        lost |= (missing & on).any(axis=1)
                    with np.errstate(invalid="ignore", over="ignore"):
                        z = np.where(on, rows * 2.0, 0.0) @ w.T + b
                        z -= z.max(axis=1, keepdims=True)
                        p = np.exp(z)
                        mean = mean + p / p.sum(axis=1, keepdims=True) * (weight / len(weights))
                out[i], null[i] = mean.max(axis=1), lost
        return pa.array(out, pa.float64(), mask=null)

    scores.__annotations__ = {"ids": pa.Array, "x": pa.Array, "return": pa.Array}  # the types themselves, not their names
    return F.arrow_udf(scores, "double")


def igeood_logits(z: Column, centroids: Column, temperature: float = 1.0) -> Column:
    """Mean Fisher-Rao distance of the softmax to those of the class-mean logits."""
    p = vec.softmax(vec.scaled(z, 1.0 / temperature))

    def distance(mu: Column) -> Column:
        q = vec.softmax(vec.scaled(mu, 1.0 / temperature))
        s = vec.total(F.zip_with(p, q, lambda a, b: F.sqrt(a) * F.sqrt(b)))
        return 2.0 * F.acos(vec.clip(s, -1 + 1e-12, 1 - 1e-12))

    return vec.total(F.transform(centroids, distance)) / F.size(centroids)


def class_logit_means(fit: DataFrame) -> DataFrame:
    """One row (centroids): mean logits of each true class, in the order of the labels."""
    long = fit.select("label", F.posexplode("z").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("m"))
    rows = long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm")).select(F.struct("label", F.transform("pm", lambda s: s["m"]).alias("mu")).alias("s"))
    return rows.agg(F.array_sort(F.collect_list("s")).alias("s")).select(F.transform("s", lambda r: r["mu"]).alias("centroids"))


def kl_matching_fit(fit: DataFrame) -> DataFrame:
    """(pred, q): mean probabilities of each predicted class."""
    p = fit.select(vec.argmax(F.col("z")).alias("pred"), F.posexplode(vec.softmax(F.col("z"))).alias("pos", "v")).groupBy("pred", "pos").agg(F.avg("v").alias("m"))
    return p.groupBy("pred").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm")).select("pred", F.transform("pm", lambda s: s["m"]).alias("q"))


def kl_matching(df: DataFrame, centroids: DataFrame, semantics: str = "reference") -> DataFrame:
    """df with `score` = -KL(p, q of the predicted class). A class that was never predicted in the fit is an error.

    reference: a probability of 0 makes the score NaN; paper: its term counts 0.
    """
    joined = df.withColumn("pred", vec.argmax(F.col("z"))).join(centroids, "pred", "left")
    q = F.when(F.col("q").isNotNull(), F.col("q")).otherwise(F.raise_error(F.lit("kl_matching: predicted class without a centroid")).cast("array<double>"))
    zero = F.lit(float("nan") if semantics == "reference" else 0.0)
    kl = vec.total(F.zip_with(vec.softmax(F.col("z")), q, lambda a, b: F.when(a > 0, a * F.ln(a / (b + 1e-6))).otherwise(zero)))
    return joined.withColumn("score", -kl).drop("q")


def js_divergence(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)

    def kl(a: Column) -> Column:
        return vec.total(F.zip_with(a, m, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)))

    return (kl(p) + kl(q)) / 2


def in_top_k(z: Column, labels: Column, label: Column, k: int) -> Column:
    """Whether the true class is among the k largest logits (its logit is at least the k-th largest)."""
    own = F.element_at(z, F.array_position(labels, label).cast("int"))
    return own >= F.element_at(F.sort_array(z, asc=False), k)

