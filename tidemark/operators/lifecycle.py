"""Scorers under their names: fit on a table, score a table, copy with other parameters, save and load.

A function detector is a column builder of the logits; a class detector fits parameters first. Batch accumulation and
device moves of other systems have no counterpart: fitting is one or a few aggregate jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vec
from tidemark.operators import features, gmm, logits
from tidemark.plans.fixtures import class_means, head_of, with_logits, with_params

#: Column names; no session is needed to import this module.
X, Z, W, B, MUS = "x", "z", "w", "b", "mus"
#: name -> builder(rows with x, z, w, b, mus; fit rows; parameters) -> rows with score
_SCORERS: dict[str, Callable[..., DataFrame]] = {}
# The search spaces of the scorers' parameters; a range has both ends and a step.
HYPERPARAMETERS: dict[str, dict[str, object]] = {
    "dice": {"p": {"low": 0.5, "high": 0.95, "step": 0.05}},
    "doctor": {"temperature": {"low": 0.1, "high": 1000, "step": 0.1}, "eps": {"low": 0.0, "high": 0.005, "step": 0.0001}},
    "energy": {"temperature": {"low": 1, "high": 1000, "step": 1.0}, "eps": {"low": 0, "high": 0.01, "step": 0.001}},
    "gmm": {"kind": ["full", "tied", "diag"], "k": [None, 16, 128, 256]},
    "gradnorm": {"temperature": {"low": 0.1, "high": 1000, "step": 0.1}},
    "igeood_features": {},
    "igeood_logits": {"temperature": {"low": 0.1, "high": 1000, "step": 0.1}},
    "knn_cosine": {"k": {"low": 1, "high": 100, "step": 5}, "avg_topk": [True, False]},
    "knn_euclides": {"k": {"low": 1, "high": 100, "step": 5}, "avg_topk": [True, False]},
    "knn_projection": {"k": {"low": 1, "high": 100, "step": 5}, "avg_topk": [True, False]},
    "l1norm": {},
    "mahalanobis": {"method": ["EmpiricalCovariance", "GraphicalLasso", "GraphicalLassoCV", "LedoitWolf", "ShrunkCovariance", "OAS"]},
    "odin": {"temperature": {"low": 0.1, "high": 1000, "step": 0.1}, "eps": {"low": 0.0, "high": 0.005, "step": 0.0001}},
    "react": {"p": {"low": 0.1, "high": 1.0, "step": 0.05}},
    "relative_mahalanobis": {"method": ["EmpiricalCovariance", "GraphicalLasso", "GraphicalLassoCV", "LedoitWolf", "ShrunkCovariance", "OAS"]},
    "ssd": {"k": {"low": 1, "high": 2048, "step": 1}},
}


def grid(name: str, most: int = 5) -> list[dict[str, object]]:
    """Trials over a scorer's search space: every choice of a list, at most `most` evenly spaced steps of a range."""
    trials: list[dict[str, object]] = [{}]
    for key, space in hyperparameters(name).items():
        if isinstance(space, dict):
            steps = int((space["high"] - space["low"]) / space["step"] + 1e-9)
            places = sorted({round(i * steps / max(1, most - 1)) for i in range(most)})
            space = [round(space["low"] + p * space["step"], 10) for p in places]
            space = [int(v) for v in space] if key == "k" else space
        trials = [t | {key: v} for t in trials for v in space]
    return trials


def register_scorer(name: str) -> Callable:
    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _SCORERS[name] = fn
        return fn

    return add


def _column(name: str, build: Callable[..., Column]) -> None:
    _SCORERS[name] = lambda rows, fit, **p: rows.withColumn("score", build(**p))


_column("random", lambda seed=0: logits.random_score(seed))
_column("always_one", lambda: logits.always(1))
_column("always_zero", lambda: logits.always(0))
_column("msp", lambda: logits.msp(Z))
_column("max_logits", lambda: logits.max_logits(Z))
_column("argm", lambda: logits.argm(Z))
_column("entropy", lambda: logits.entropy(Z))
_column("gradnorm", lambda temperature=1.0: logits.gradnorm(Z, X, temperature))
_column("l1norm", lambda: features.l1norm(X))
_column("maxcosine", lambda: features.maxcosine(X, MUS))
_column("projection", lambda: features.projection(X, MUS, vec.softmax(Z)))
_column("dice", lambda p=0.7: vec.lse(vec.matvec(features.dice_weights(W, p), X, B)))


def _with_eps(name: str, score: Callable[[Column, float], Column], default: float) -> None:
    def run(rows: DataFrame, fit: DataFrame, temperature: float = default, eps: float = 0.0) -> DataFrame:
        if eps == 0.0:
            return rows.withColumn("score", score(Z, temperature))
        moved = rows.withColumn("_x", logits.perturbed(X, Z, W, name, eps, temperature))
        return moved.withColumn("_z", vec.matvec(W, F.col("_x"), B)).withColumn("score", score(F.col("_z"), temperature)).drop("_x", "_z")

    _SCORERS[name] = run


_with_eps("energy", logits.energy, 1.0)
_with_eps("odin", logits.odin, 1000.0)
_with_eps("doctor", logits.doctor, 1.0)


def _fit_logits(fit: DataFrame) -> DataFrame:
    return with_logits(fit, head_of(class_means(fit)))


@register_scorer("mcdropout")
def _mcdropout(rows, fit, passes: int = 5, semantics: str = "reference"):
    return logits.mcdropout(rows, passes, semantics=semantics)


@register_scorer("igeood_logits")
def _igeood_logits(rows, fit, temperature: float = 1.0):
    return with_params(rows, logits.class_logit_means(_fit_logits(fit))).withColumn("score", logits.igeood_logits(Z, F.col("centroids"), temperature)).drop("centroids")


@register_scorer("igeood_features")
def _igeood_features(rows, fit):
    params = features.igeood_features_fit(fit).withColumnRenamed("mus", "_mus")
    return with_params(rows, params).withColumn("score", features.igeood_features(X, F.col("_mus"), F.col("sigma"))).drop("_mus", "sigma")


@register_scorer("kl_matching")
def _kl_matching(rows, fit, semantics: str = "reference"):
    return logits.kl_matching(rows, logits.kl_matching_fit(_fit_logits(fit)), semantics)


@register_scorer("react")
def _react(rows, fit, p: float = 0.9):
    t = features.react_threshold(fit, p)
    return rows.withColumn("score", vec.lse(vec.matvec(W, features.clipped(X, t), B)))


@register_scorer("react_projection")
def _react_projection(rows, fit, threshold: float | None = None, p: float = 0.9):
    t = features.react_threshold(fit, p) if threshold is None else threshold
    x = features.clipped(X, t)
    return rows.withColumn("score", features.projection(x, MUS, vec.softmax(vec.matvec(W, x, B))))


for _name in ("knn_euclides", "knn_cosine", "knn_projection"):
    _SCORERS[_name] = lambda rows, fit, name=_name, **p: features.knn(rows, fit, name, **p)
_SCORERS["csi"] = lambda rows, fit: features.csi(rows, fit)
_SCORERS["mahalanobis"] = lambda rows, fit, **p: features.mahalanobis(rows.drop("w", "mus", "b", "labels", "z"), fit, **p)
_SCORERS["relative_mahalanobis"] = lambda rows, fit, **p: features.relative_mahalanobis(rows.drop("w", "mus", "b", "labels", "z"), fit, **p)
_SCORERS["gmm"] = lambda rows, fit, **p: gmm.gmm(rows.drop("w", "mus", "b", "labels", "z"), fit, **p)
_SCORERS["ssd"] = lambda rows, fit, **p: features.ssd(rows.drop("w", "mus", "b", "labels", "z"), fit, **p)


@register_scorer("vim")
def _vim(rows, fit, top_k: int | None = None):
    head = rows.select("w", "b").first()
    return features.vim(rows.drop("w", "mus", "b", "labels", "z"), fit, np.array(head.w), np.array(head.b), top_k)


def list_scorers() -> list[str]:
    return sorted(_SCORERS)


def hyperparameters(name: str) -> dict[str, object]:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(list_scorers())}")
    return HYPERPARAMETERS.get(name, {})


@dataclass(frozen=True)
class Detector:
    """fit(rows) -> Fitted; parameters are fixed at creation and changed by with_params() only."""

    name: str
    params: dict[str, object] = field(default_factory=dict)

    def with_params(self, **params: object) -> Detector:
        return replace(self, params={**self.params, **params})

    def fit(self, rows: DataFrame) -> Fitted:
        """rows: id, x, label. The linear head comes from the class means."""
        return Fitted(self, rows, head_of(class_means(rows)))


@dataclass(frozen=True)
class Fitted:
    detector: Detector
    rows: DataFrame
    head: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """(id, domain if there, score) of df (id, x, ...)."""
        out = _SCORERS[self.detector.name](with_logits(df, self.head), self.rows, **self.detector.params)
        return out.select(*[c for c in ("id", "domain") if c in df.columns], "score")

    def save(self, path: str) -> None:
        """Head and fit rows as Parquet, name and parameters as JSON."""
        import json

        spark = self.rows.sparkSession
        self.head.write.mode("overwrite").parquet(f"{path}/head")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(self.detector.name, json.dumps(self.detector.params))], "name string, params string").write.mode("overwrite").parquet(f"{path}/detector")


def load(spark: SparkSession, path: str) -> Fitted:
    import json

    d = spark.read.parquet(f"{path}/detector").first()
    return Fitted(Detector(d.name, json.loads(d.params)), spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/head"))


def create_scorer(name: str, **params: object) -> Detector:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(list_scorers())}")
    return Detector(name, params)
