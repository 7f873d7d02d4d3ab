"""Isolation forest: sampling and scoring are distributed, a few trees are one small group."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .slices import floor_div

EULER = 0.5772156649015329
MIN_ROWS = 2
HASH_SPAN = float(1 << 62)
TREES_PER_GROUP = 10
#: Rows a tree draws before ranking, as a multiple of the rows it keeps.
DRAWN = 3.0
#: Share of drawn cells from which testing each cell costs no more than leaping.
DENSE = 0.05
ROWS_PER_BLOCK = 4096


def expected_depth(n):
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def training_sizes(rows: DataFrame, keys: Sequence[str], many: str | None) -> DataFrame:
    """Training rows of every model, written as a small table of known size."""
    own = [k for k in keys if k != many]
    members = rows.groupBy(*own, *([_members(many)] if many else [])).agg(F.count(F.lit(1)).alias("_n"))
    if many:
        members = members.select(*own, F.explode(_members(many)).alias(many), "_n")
    sizes = members.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    return materialize(sizes, "training-sizes")


def _members(many: str) -> str:
    """Column that lists the models a row belongs to."""
    return f"{many}s"


def sample_trees(
    rows: DataFrame,
    keys: Sequence[str],
    row_id: str,
    trees: int,
    tree_rows: int,
    seed: int,
    many: str | None = None,
) -> DataFrame:
    """Rows of every tree, drawn without replacement by hash rank from all rows of its model.

    A row's chances are one sequence of cells, one for each of its models and trees. It leaps from one
    drawn cell to the next by hashed gaps, so most rows cost a single hash and are never copied: a tree
    keeps about three times its rows before ranking, or all rows of a smaller set. With ``many``,
    that key is a list column (``<many>s``) of the models that share the row.
    """
    own = [k for k in keys if k != many]
    sizes = training_sizes(rows, keys, many)
    label = many or "_one"
    models = sizes if many else sizes.withColumn(label, F.lit(0))
    listed = models.groupBy(*own).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(label).alias("model"), F.col("_size").alias("size")))
        ).alias("_models")
    )
    joined = rows.join(listed, own)
    if many:
        members = _members(many)
        mine = F.filter("_models", lambda m: F.array_contains(members, m["model"]))
        whole = F.size(members) == F.size("_models")
        joined = joined.withColumn("_models", F.when(whole, F.col("_models")).otherwise(mine))

    def chance(size: Column) -> Column:
        """Share of a model's rows that each of its trees draws before ranking."""
        return F.least(F.lit(1.0), F.lit(DRAWN * tree_rows) / size)

    smallest = F.array_min(F.transform("_models", lambda m: m["size"]))
    placed = joined.withColumn("_share", chance(smallest)).withColumn("_cells", F.size("_models") * trees)

    def uniform(*parts: Column) -> Column:
        """A number between 0 and 1 that only the row and the parts decide."""
        bits = F.xxhash64(*own, row_id, *parts, F.lit(seed)).bitwiseAND((1 << 62) - 1)
        return (bits + F.lit(0.5)) / F.lit(HASH_SPAN)

    def gap(i: Column) -> Column:
        return F.floor(F.log(uniform(i)) / F.log1p(-F.col("_share")))

    def leap(state: Column, i: Column) -> Column:
        to = state["at"] + 1 + gap(i)
        on = F.struct(to.alias("at"), F.concat(state["cells"], F.array(to)).alias("cells"))
        return F.when(state["at"] >= F.col("_cells"), state).otherwise(on)

    expected = F.col("_share") * F.col("_cells")
    most = F.ceil(expected + 10 * F.sqrt(expected) + 20)  # leaps that suffice but once in 10 ** 20
    first = gap(F.lit(0).cast("bigint"))
    walked = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), most),
        F.struct(first.alias("at"), F.array(first).alias("cells")),
        leap,
        lambda s: F.filter(s["cells"], lambda c: c < F.col("_cells")),
    )
    every = F.sequence(F.lit(0).cast("bigint"), (F.col("_cells") - 1).cast("bigint"))
    tested = F.filter(every, lambda c: uniform(c) < F.col("_share"))
    none = F.expr("cast(array() as array<bigint>)")
    chosen = (
        F.when(F.col("_share") >= DENSE, tested)
        .when(first >= F.col("_cells"), none)
        .otherwise(walked)
    )

    def drawn(cell: Column) -> Column:
        model = F.get("_models", F.floor(cell / trees).cast("int"))
        tree = F.pmod(cell, F.lit(trees)).cast("int")
        rank = F.xxhash64(*own, model["model"], row_id, tree, F.lit(seed)).bitwiseAND((1 << 62) - 1)
        # models with more rows than the smallest one keep fewer of the cells
        kept = uniform(cell, F.lit("kept")) * F.col("_share") < chance(model["size"])
        return F.when(
            kept,
            F.struct(
                model["model"].alias(label), model["size"].alias("_size"), tree.alias("tree"), rank.alias("_rank")
            ),
        )

    draws = placed.select(
        *own,
        row_id,
        *_features(rows, keys, row_id, many),
        F.explode(F.array_compact(F.transform(chosen, drawn))).alias("_d"),
    )
    return draws.select("*", "_d.*").drop("_d", *(() if many else (label,)))


def _features(rows: DataFrame, keys: Sequence[str], row_id: str, many: str | None) -> list[str]:
    skip = {*keys, row_id, *([_members(many)] if many else [])}
    return [c for c in rows.columns if c not in skip]


def _grow(x: np.ndarray, tree: np.ndarray, trees: int, limit: int, rng) -> list[np.ndarray]:
    """Isolate the rows of several trees by random cuts, one level of all trees at a time.

    Nodes are laid out by position: node ``i`` has the children ``2i + 1`` and ``2i + 2``. A leaf
    has feature -1 and the depth it stands for.
    """
    size = 2 ** (limit + 1) - 1
    feature = np.full((trees, size), -1, dtype=np.int32)
    cut, depth = np.zeros((trees, size)), np.zeros((trees, size))
    node = np.zeros(len(x), dtype=np.int64)
    for level in range(limit + 1):
        place = tree * size + node
        order = np.argsort(place, kind="stable")
        x, tree, node, place = x[order], tree[order], node[order], place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        usable = high > low
        cuttable = usable.any(axis=1) & (count > 1) & (level < limit)
        chosen = np.where(usable, rng.random(usable.shape), -1.0).argmax(axis=1)
        at = np.arange(len(first))
        lo, hi = low[at, chosen], high[at, chosen]
        # Strictly below the maximum, so that both sides keep at least one row.
        value = np.minimum(lo + rng.random(len(first)) * (hi - lo), np.nextafter(hi, -np.inf))
        where = (tree[first], node[first])
        feature[where] = np.where(cuttable, chosen, -1)
        cut[where] = np.where(cuttable, value, 0.0)
        depth[where] = np.where(cuttable, 0.0, level + expected_depth(count))
        inside = np.repeat(at, count)
        right = x[np.arange(len(x)), chosen[inside]] > value[inside]
        keep = cuttable[inside]
        x, tree, node = x[keep], tree[keep], (2 * node + 1 + right)[keep]
        if not len(x):
            break
    return [feature, cut, depth]


def fit_forest(
    rows: DataFrame,
    keys: Sequence[str],
    row_id: str,
    features: str,
    *,
    trees: int,
    tree_rows: int,
    seed: int,
    many: str | None = None,
) -> DataFrame:
    """One row per tree: its nodes as arrays. All keys are fitted in one job.

    ``features`` is an array column. Keys with fewer than two rows get no forest. ``many`` names a
    key that rows list as ``<many>s``, as one row may train many models.
    """
    keys = list(keys)
    held = [_members(k) if k == many else k for k in keys]
    sampled = sample_trees(
        rows.select(*held, row_id, features), keys, row_id, trees, tree_rows, seed, many
    ).withColumn("_block", F.floor(F.col("tree") / TREES_PER_GROUP))
    limit = math.ceil(math.log2(max(tree_rows, 2)))
    names = [*keys, "tree", "sample", "feature", "cut", "depth"]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["_size"].iloc[0] < MIN_ROWS:
            return pd.DataFrame(columns=names)
        ranked = pdf.sort_values(["tree", "_rank", row_id])
        chosen = ranked.groupby("tree").head(tree_rows).sort_values(["tree", row_id])
        x = np.stack(chosen[features].to_numpy()).astype(float)
        numbers, tree, sample = np.unique(
            chosen["tree"].to_numpy(), return_inverse=True, return_counts=True
        )
        own = zlib.crc32(repr([pdf[k].iloc[0] for k in keys]).encode())
        rng = np.random.default_rng([seed, int(numbers[0]), own])
        nodes = _grow(x, tree, len(numbers), limit, rng)
        out = {k: [pdf[k].iloc[0]] * len(numbers) for k in keys}
        out |= {"tree": numbers, "sample": sample}
        return pd.DataFrame(out | {n: list(a) for n, a in zip(names[-3:], nodes, strict=True)})

    types = {f.name: f.dataType.simpleString() for f in sampled.schema}
    schema = ", ".join(
        [f"{k} {types[k]}" for k in keys]
        + ["tree int", "sample int", "feature array<int>", "cut array<double>"]
        + ["depth array<double>"]
    )
    return sampled.groupBy(*keys, "_block").applyInPandas(grow, schema)


def _mean_depth(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: np.ndarray):
    """Mean leaf depth of every row over all trees, a block of rows at a time."""
    out = np.empty(len(x))
    tree = np.arange(len(feature))[None, :]
    for start in range(0, len(x), ROWS_PER_BLOCK):
        part = x[start : start + ROWS_PER_BLOCK]
        row = np.arange(len(part))[:, None]
        node = np.zeros((len(part), len(feature)), dtype=np.int64)
        while True:
            f = feature[tree, node]
            inner = f >= 0
            if not inner.any():
                break
            right = part[row, np.maximum(f, 0)] > cut[tree, node]
            node = np.where(inner, 2 * node + 1 + right, node)
        out[start : start + len(part)] = depth[tree, node].mean(axis=1)
    return out


def score_forest(
    rows: DataFrame,
    forest: DataFrame,
    keys: Sequence[str],
    us: str,
    features: str,
    width: int,
    output: str = "anomaly_score",
    many: str | None = None,
    others: Sequence[str] = (),
) -> DataFrame:
    """Higher is more anomalous: ``2^(-E[depth]/c(sample)) - 0.5``.

    Rows meet their forests in groups of one key and one time slice, so a group is bounded, and
    with ``many`` (rows list the models that score them as ``<many>s``) a row is there once for all
    of its models. A slice gets the forests that its rows ask for. Every row is returned, with its
    columns ``others``, once for each of its models; without features or forest its score is null.
    """
    keys = list(keys)
    own_keys = [k for k in keys if k != many]
    held = [*own_keys, *([_members(many)] if many else [])]
    sliced = rows.select(*held, us, features, *others).withColumn("_slice", floor_div(F.col(us), width))
    asked = sliced.select(
        *own_keys, "_slice", *([F.explode(_members(many)).alias(many)] if many else [])
    ).distinct()
    # The cogroup needs distinct column names on its two sides.
    group = [*own_keys, "_slice"]
    renamed = [f"_m_{k}" for k in group]
    models = asked.join(forest, keys).select(
        *[F.col(k).alias(o) for k, o in zip(group, renamed, strict=True)],
        *([many] if many else []),
        "sample",
        "feature",
        "cut",
        "depth",
    )
    types = {f.name: f.dataType.simpleString() for f in (*rows.schema, *forest.schema)}
    names = [*keys, us, *others, output]
    schema = ", ".join([f"{c} {types[c]}" for c in names[:-1]] + [f"{output} double"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=names)
        at, asked_for = np.arange(len(left)), np.zeros(len(left), np.int64)
        if many:
            lists = left[_members(many)].to_numpy()
            at = np.repeat(at, [len(x) for x in lists])
            asked_for = np.concatenate([np.zeros(0, np.int64), *lists])
        known = left[features].notna().to_numpy()
        place = np.cumsum(known) - 1
        found = np.full(len(at), np.nan)
        if known.any():
            x = np.stack(left[features].to_numpy()[known]).astype(float)
            for model, trees in right.groupby(many) if many else [(0, right)] if len(right) else ():
                chosen = np.flatnonzero((asked_for == model) & known[at])
                nodes = [np.stack(trees[c].to_numpy()) for c in ("feature", "cut", "depth")]
                scale = float(expected_depth(float(trees["sample"].iloc[0])))
                depth = _mean_depth(x[place[at[chosen]]], *nodes)
                found[chosen] = 2.0 ** (-depth / scale) - 0.5
        out = left[[*own_keys, us, *others]].iloc[at].reset_index(drop=True)
        if many:
            out[many] = asked_for
        out[output] = pd.Series(found, dtype=object).where(~np.isnan(found), None)
        return out[names]

    return sliced.groupBy(*group).cogroup(models.groupBy(*renamed)).applyInPandas(score, schema)
