"""Supervised and information-theoretic ensembles of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weight_regression(df: DataFrame, split: int, s: str = "s", folds: int = 3) -> DataFrame:
    """(id, label, score) of the rows after the first `split` of each label (by id): probabilities of a cross-validated logistic regression on the first ones."""
    from pyspark.sql.window import Window

    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("id"))).withColumn("v", array_to_vector(s))
    train = rows.where(F.col("_r") <= split).select("v", F.col("label").cast("double").alias("label"))
    lr = LogisticRegression(featuresCol="v", labelCol="label")
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-4, 1e-2, 1.0]).build()
    model = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="label"), numFolds=folds, seed=0).fit(train).bestModel
    return model.transform(rows.where(F.col("_r") > split)).select("id", "label", F.element_at(vector_to_array("probability"), 2).alias("score"))


def max_min_weights(p: np.ndarray, steps: int = 200, rate: float = 0.5) -> np.ndarray:
    """Weights on the simplex that make max_j sum_i w_i KL(p_i, p_j) least, by entropic mirror descent. p: [methods, 2]."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    kl = (p[:, None, :] * np.log(p[:, None, :] / p[None, :, :])).sum(2)  # kl[i, j]
    w = np.full(len(p), 1 / len(p))
    best, value = w, np.inf
    for t in range(steps):
        sums = w @ kl
        j = int(sums.argmax())
        if sums[j] < value:
            best, value = w, sums[j]
        g = kl[:, j]
        w = w * np.exp(-rate / np.sqrt(t + 1) * (g - g.min()))
        w = w / w.sum()
    return best


def mutual_information(df: DataFrame, s: str = "s") -> DataFrame:
    """df with `score`: each row's probabilities of all methods, averaged by its own max-min weights. s: array of probabilities."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf[s]:
                q = np.asarray(row, np.float64)
                out.append(float(max_min_weights(np.column_stack([q, 1 - q])) @ q))
            yield pdf.assign(score=np.array(out, np.float64))

    return df.mapInPandas(run, schema)
