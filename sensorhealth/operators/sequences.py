"""Linear reconstruction of whole sequence windows, in their order.

A window of ``length`` rows is one vector of ``length * size`` numbers, oldest row first, so the model sees
how rows follow each other: the same rows in another order score differently. Its second moments are a
block Hankel matrix of lagged cross products, which are summed from shifted views of the rows; windows
are never laid out. Rows are dealt out by run position (``run_chunks``), and short runs that start in the
same time span share a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reconstruction import summed_cells
from .runs import run_chunks
from .slices import floor_div

#: Numbers that a task holds in sums of different models before it sends them.
HELD = 32 << 20


def _window_ends(frame: pd.DataFrame, keys: list[str], run: str, position: str, length: int) -> np.ndarray:
    """Row numbers at which a complete window ends; ``frame`` is sorted by keys, run and position."""
    place = frame[position].to_numpy()
    whole = np.zeros(len(frame), bool)
    if len(frame) >= length:
        whole[length - 1 :] = place[length - 1 :] - place[: len(place) - length + 1] == length - 1
        for c in [*keys, run]:
            own = frame[c].to_numpy()
            whole[length - 1 :] &= own[length - 1 :] == own[: len(own) - length + 1]
    return np.flatnonzero(whole)


def _pairs(frame: pd.DataFrame, ends: np.ndarray, many: str) -> tuple[np.ndarray, np.ndarray]:
    """(window end, model) of every model that the rows at the ends list."""
    lists = [np.asarray(x if x is not None else (), np.int64) for x in frame[many].to_numpy()[ends]]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(ends, sizes), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)


def lagged_products(x: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Count, sums and cross products of the windows that end at ``ends``, as one flat array."""
    size = x.shape[1]
    sums, cross = np.zeros((length, size)), np.zeros((length, size, length, size))
    views = [x[ends - (length - 1) + i] for i in range(length)]
    for i, a in enumerate(views):
        sums[i] = a.sum(axis=0)
        for j in range(i, length):
            cross[i, :, j] = a.T @ views[j]
            cross[j, :, i] = cross[i, :, j].T
    return np.concatenate([[len(ends)], sums.ravel(), cross.ravel()])


def window_moments(
    rows: DataFrame, keys: Sequence[str], run: str, position: str, features: str, many: str, model: str, length: int
) -> DataFrame:
    """(keys, model, cell, amount): summed moments of the training windows of every model.

    A row lists in ``many`` the models that the window ending at it trains (null for none).
    """
    keys = list(keys)
    block = max(1, length - 1)
    chunked = run_chunks(rows.select(*keys, run, position, features, many), keys, run, position, block)
    # a copied row only completes windows of the rows behind it
    own = chunked.withColumn(many, F.when(~F.col("_copy"), F.col(many)))
    order = [*keys, run, "_chunk", position]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{model} int", "cells array<double>"])

    def pack(sums: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(sums), columns=[*keys, model])
        out["cells"] = [v.tolist() for v in sums.values()]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        before = None
        for batch in batches:
            fresh = len(batch)
            if before is not None:
                batch = pd.concat([before, batch], ignore_index=True)
            ends = _window_ends(batch, [*keys, "_chunk"], run, position, length)
            ends = ends[ends >= len(batch) - fresh]
            ends, models = _pairs(batch, ends, many)
            before = batch.tail(length - 1) if length > 1 else None
            if not len(ends):
                continue
            x = np.stack(batch[features].to_numpy()).astype(float)
            groups = batch[keys].iloc[ends].assign(**{model: models}).reset_index(drop=True)
            for key, group in groups.groupby([*keys, model], sort=False):
                sums[key] = sums.get(key, 0.0) + lagged_products(x, ends[group.index.to_numpy()], length)
            if sum(map(len, sums.values())) > HELD:
                yield pack(sums)
                sums = {}
        if sums:
            yield pack(sums)

    parts = own.sortWithinPartitions(*order).select(*keys, run, "_chunk", position, features, many)
    return summed_cells(parts.mapInPandas(partial, schema), [*keys, model])


def _errors(x: np.ndarray, ends: np.ndarray, mean: np.ndarray, components: np.ndarray, length: int) -> np.ndarray:
    """Mean squared reconstruction error of the windows that end at ``ends``."""
    size = x.shape[1]
    mean, parts = mean.reshape(length, size), components.reshape(-1, length, size)
    squares, loads = np.zeros(len(ends)), np.zeros((len(ends), len(parts)))
    for i in range(length):
        centred = x[ends - (length - 1) + i] - mean[i]
        squares += (centred * centred).sum(axis=1)
        loads += centred @ parts[:, i].T
    return np.maximum(0.0, squares - (loads * loads).sum(axis=1)) / (length * size)


def score_windows(
    rows: DataFrame,
    models: DataFrame,
    keys: Sequence[str],
    us: str,
    run: str,
    position: str,
    features: str,
    many: str,
    model: str,
    length: int,
    width: int,
    others: Sequence[str] = (),
    output: str = "anomaly_score",
) -> DataFrame:
    """Error of the window that ends at each row under every model the row lists in ``many``.

    ``models`` has ``keys, model, mean, components`` (arrays over whole windows). A row without
    features, or whose model was never fitted, has an undefined score.
    """
    keys = list(keys)
    own = rows.select(*keys, us, run, position, features, many, *others)
    chunked = run_chunks(own, keys, run, position, max(1, length - 1))
    placed = chunked.withColumn("_span", floor_div(F.col(run), width)).withColumn(
        many, F.when(~F.col("_copy"), F.col(many))
    )
    group = [*keys, "_span", "_chunk"]
    renamed = [f"_m_{k}" for k in group]
    asked = placed.select(*group, F.explode(many).alias(model)).distinct()
    known = asked.join(models.select(*keys, model, "mean", "components"), [*keys, model]).select(
        *[F.col(k).alias(o) for k, o in zip(group, renamed, strict=True)], model, "mean", "components"
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, us, *others)] + [f"{model} int", f"{output} double"])
    names = [*keys, us, *others, model, output]

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        left = left.sort_values([run, position], ignore_index=True)
        ends, wanted = _pairs(left, _window_ends(left, [], run, position, length), many)
        out = left[[*keys, us, *others]].iloc[ends].reset_index(drop=True)
        found = np.full(len(ends), np.nan)
        usable = left[features].notna().to_numpy()
        if usable.all() and len(right):
            x = np.stack(left[features].to_numpy()).astype(float)
            for number, mean, components in zip(right[model], right["mean"], right["components"], strict=True):
                chosen = np.flatnonzero(wanted == number)
                fitted = np.stack(components) if len(components) else np.zeros((0, len(mean)))
                found[chosen] = _errors(x, ends[chosen], np.asarray(mean), fitted, length)
        scores = pd.Series(found, dtype=object).where(~np.isnan(found), None)
        return out.assign(**{model: wanted, output: scores})[names]

    return placed.groupBy(*group).cogroup(known.groupBy(*renamed)).applyInPandas(score, schema)
