"""Batch scoring with a user's model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.claims import best_effort


def batch_score(df: DataFrame, make_predict_fn: Callable, column: str, width: int, out: str = "score",
                batch_size: int = 1024, return_type: T.DataType | None = None) -> DataFrame:
    """Score an array column; the loader runs once per Python worker, rows go in batches."""
    score = predict_batch_udf(
        make_predict_fn, return_type=return_type or T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return df.withColumn(out, score(F.col(column)))


def bisected(fn: Callable[[pd.Series], pd.Series], values: pd.Series, default: object) -> tuple[list, list]:
    """Values and errors of a vectorised function; a failing batch is halved until the failing rows stand alone.

    f failing rows among n cost O(f log n) calls; a batch without one costs a single call.
    """
    out: list = [default] * len(values)
    errors: list = [None] * len(values)
    waiting = [(0, len(values))] if len(values) else []
    while waiting:
        a, b = waiting.pop()
        try:
            found = list(fn(values.iloc[a:b]))
            if len(found) != b - a:
                raise ValueError(f"{len(found)} values for {b - a} rows")
            out[a:b] = found
        except Exception as exc:  # a bad row must not stop the job
            if b - a == 1:
                errors[a] = f"{type(exc).__name__}: {exc}"
            else:
                middle = (a + b) // 2
                waiting += [(middle, b), (a, middle)]
    return out, errors


def best_effort_batch(fn: Callable[[pd.Series], pd.Series], column: Column, default: object, value_type: str) -> Column:
    """struct(value, error) of a vectorised function that may fail on single rows."""

    @F.pandas_udf(f"value {value_type}, error string")
    def apply(values: pd.Series) -> pd.DataFrame:
        out, errors = bisected(fn, values, default)
        return pd.DataFrame({"value": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    return apply(column)


def best_effort_column(fn: Callable, column: Column, default: object, value_type: str) -> Column:
    """struct(value, error) of a per-value function that may fail on single rows."""
    guarded = best_effort(fn, default)

    @F.pandas_udf(f"value {value_type}, error string")
    def apply(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([guarded(v) for v in values], columns=["value", "error"])

    return apply(column)
