"""The seam to networks: features and logits from a model's batch function, as columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODELS: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def register_model(name: str) -> Callable:
    """Registers make() -> fn(batch) -> outputs; make runs once in each worker, and loads the weights there."""

    def add(make: Callable) -> Callable:
        _MODELS[name] = make
        return make

    return add


def list_models() -> list[str]:
    return sorted(_MODELS)


def with_outputs(df: DataFrame, name: str, inputs: str, size: int, out: str = "x", batch: int = 256) -> DataFrame:
    """df with the model's output vectors of the array column `inputs`, whose rows have `size` elements."""
    if name not in _MODELS:
        raise ValueError(f"unknown model {name}; known: {', '.join(list_models())}")
    udf = predict_batch_udf(_MODELS[name], return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[size]])
    return df.withColumn(out, udf(F.col(inputs)))
