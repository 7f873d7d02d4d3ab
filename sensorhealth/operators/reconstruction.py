"""Linear reconstruction model: principal components per key, window scores and SMAPE."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMAPE_EPSILON = 1e-8


#: Cells of a model that one group folds over the cycles of its key.
CELLS_PER_GROUP = 4096


def row_moments(rows: DataFrame, keys: Sequence[str], features: str, size: int) -> DataFrame:
    """(keys, cell, amount): weight, weighted sums and cross products of the rows of every key.

    Each task reduces its rows to these ``size**2 + size + 1`` numbers per key; only they are shuffled
    and summed. A column ``weight`` counts a row several times.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, group in batch.groupby(keys, sort=False):
                x = np.stack(group[features].to_numpy()).astype(float)
                w = group["weight"].to_numpy(dtype=float)
                xw = x * w[:, None]
                part = np.concatenate([[w.sum()], xw.sum(axis=0), (xw.T @ x).ravel()])
                sums[key] = sums.get(key, 0.0) + part
            if len(sums) > 256:
                yield pack(sums)
                sums = {}
        if sums:
            yield pack(sums)

    def pack(sums: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(sums), columns=keys)
        out["cells"] = [v.tolist() for v in sums.values()]
        return out

    parts = rows.select(*keys, features, "weight").mapInPandas(
        partial, ", ".join([*(f"{k} {types[k]}" for k in keys), "cells array<double>"])
    )
    return summed_cells(parts, keys)


def summed_cells(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, cell, amount) from arrays of numbers that tasks have summed."""
    return (
        parts.select(*keys, F.posexplode("cells").alias("cell", "amount"))
        .groupBy(*keys, "cell")
        .agg(F.sum("amount").alias("amount"))
    )


def chained(moments: DataFrame, keys: Sequence[str], step: str, memory: float) -> DataFrame:
    """Moments of models that each start from the one before: ``own + memory * predecessor``.

    ``step`` orders the models of the other keys. A model forgets earlier rows at the rate
    ``1 - memory`` a step; moments add up, so no earlier row is read again. Groups hold a block of cells of one key.
    """
    keys = list(keys)
    others = [k for k in keys if k != step]
    types = {f.name: f.dataType.simpleString() for f in moments.schema}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, row = np.unique(pdf[step].to_numpy(), return_inverse=True)
        cells, column = np.unique(pdf["cell"].to_numpy(), return_inverse=True)
        table = np.zeros((len(steps), len(cells)))
        table[row, column] = pdf["amount"].to_numpy()
        for i in range(1, len(steps)):
            table[i] += memory * table[i - 1]
        out = {k: pdf[k].iloc[0] for k in others}
        out |= {step: np.repeat(steps, len(cells)), "cell": np.tile(cells, len(steps)), "amount": table.ravel()}
        return pd.DataFrame(out)[[*keys, "cell", "amount"]]

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["cell int", "amount double"])
    block = F.floor(F.col("cell") / CELLS_PER_GROUP)
    return moments.withColumn("_block", block).groupBy(*others, "_block").applyInPandas(fold, schema)


def decomposed(moments: DataFrame, keys: Sequence[str], size: int, components: int) -> DataFrame:
    """Weight, mean and leading principal components of every key's small matrix."""
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in moments.schema}
    cells = size * size + size + 1

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells)
        total[pdf["cell"].to_numpy()] = pdf["amount"].to_numpy()
        n = total[0]
        mean = total[1 : size + 1] / n
        covariance = total[size + 1 :].reshape(size, size) / n - np.outer(mean, mean)
        _, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        top = vectors[:, ::-1][:, :components].T
        # Sign convention: the largest loading of a component is positive.
        top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
        out = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(
            out | {"fitted_rows": [float(n)], "mean": [mean.tolist()], "components": [top.tolist()]}
        )

    schema = [f"{k} {types[k]}" for k in keys]
    return moments.groupBy(*keys).applyInPandas(
        decompose,
        ", ".join([*schema, "fitted_rows double", "mean array<double>", "components array<array<double>>"]),
    )


def fit_components(
    rows: DataFrame, keys: Sequence[str], features: str, size: int, components: int
) -> DataFrame:
    """Mean and leading principal components per key (``mean``, ``components``)."""
    return decomposed(row_moments(rows, keys, features, size), keys, size, components)


def reconstruct(features: Column, mean: Column, components: Column) -> Column:
    """Projection of a row on the fitted components, as an array."""
    centred = F.zip_with(features, mean, lambda x, m: x - m)
    loads = F.transform(
        components,
        lambda v: F.aggregate(
            F.zip_with(v, centred, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y
        ),
    )
    parts = F.zip_with(components, loads, lambda v, p: F.transform(v, lambda a: a * p))
    return F.aggregate(parts, mean, lambda s, p: F.zip_with(s, p, lambda a, b: a + b))


def squared_error(rebuilt: Column, features: Column) -> Column:
    """Mean squared error of one row."""
    squares = F.zip_with(rebuilt, features, lambda r, x: (r - x) * (r - x))
    return F.aggregate(squares, F.lit(0.0), lambda s, y: s + y) / F.size(features)


def summed_smape(rebuilt: Column, features: Column) -> Column:
    """SMAPE of one row, summed over its features."""
    terms = F.zip_with(
        rebuilt,
        features,
        lambda r, x: 2.0 * F.abs(r - x) / (F.abs(r) + F.abs(x) + F.lit(SMAPE_EPSILON)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda s, y: s + y)


def row_errors(rows: DataFrame, features: str) -> DataFrame:
    """Mean squared error and summed SMAPE of each row against ``_fit``."""
    fit, own = F.col("_fit"), F.col(features)
    return rows.withColumn("row_mse", squared_error(fit, own)).withColumn("row_smape", summed_smape(fit, own))


def windows_holding(position: Column, rows: Column, length: int) -> Column:
    """How many complete windows of its run hold the row at 1-based ``position``."""
    inside = F.least(position, F.lit(length), rows - (length - 1), rows - position + 1)
    return F.when(rows >= length, inside).otherwise(0).cast("bigint")


def mean_smape(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """SMAPE over every element of every window, from per-row sums and window counts."""
    return rows.groupBy(*keys).agg(
        (F.sum(F.col("row_smape") * F.col("holding")) / (F.sum("holding") * size)).alias("smape"),
        F.sum("holding").alias("weighted_rows"),
    )
