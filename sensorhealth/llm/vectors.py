"""Nearest neighbours by inner product with an adaptive dimension scan over inverted lists.

Vectors get one more component that makes all of them equally long, so the largest inner product is
the smallest distance, and are turned by one random rotation, after which any leading columns are a
fair sample of all. Lists are the nearest centroids, fitted on a bounded sample (``sample_rows``); every
row is in a list. How many of its nearest lists a query probes is measured on the sample: the fewest
that hold ``recall`` of the sample's own neighbours, which lie further off than those of all rows.

Within a list, columns are read block by block; a candidate whose partial distance already exceeds
what the running k-th best distance allows (a hypothesis test at ``confidence`` deviations) is abandoned.
Sample rows in the probed lists bound the distance from the start, by a rank of ``spare * k``, so that a
wrongly abandoned one leaves enough others. Every result comes out of the scan. Survivors are ranked by
their exact inner products on the original vectors in double precision.

Lists and their queries are dealt into blocks of bounded rows, so a list that holds a third of all
rows is many groups. The best k of each block are merged per query. Broadcast are the centroids, the
sample and a table with one row for each list (``most_lists`` at most; with more rows lists grow, and are
more blocks each).

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; ties go to the smaller id; rows that repeat an id and a score count once,
a query skips all rows of its own id, and a repeated query is asked once (its least vector); with fewer
than k candidates all are returned; an empty table gives no rows; other columns are ignored. Where the
data have no clusters, most lists must be probed and work grows with queries times rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tables import settle


@dataclass(frozen=True)
class Settings:
    k: int = 20
    recall: float = 0.95
    sample_rows: int = 20_000
    bound_rows: int = 8000  # of the sample, for the first bound of a query
    spare: int = 2
    batch_rows: int = 250  # queries that meet the sample at once
    list_rows: int = 512
    most_lists: int = 2048
    column_block: int = 16
    confidence: float = 2.1
    block_rows: int = 4096
    chunk_rows: int = 1024
    sparse: float = 0.05  # share of candidates alive below which they are read one by one
    seed: int = 7


def usable(vector: Column, size: int) -> Column:
    """The vector can be compared: of this size, finite throughout, not zero."""
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    return F.coalesce((F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_size(vectors: DataFrame) -> int:
    sizes = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("size")).count()
    top = sizes.filter("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    return top["size"] if top else 0


def stacked(column: pa.Array, size: int) -> np.ndarray:
    """An array column as a matrix of doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


@dataclass(frozen=True)
class Geometry:
    """What all tasks share: length bound, rotation, centroids (of extended vectors), sample, probes."""

    bound: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    probes: int
    sample_lists: np.ndarray | None = None

    def extended(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Rows scaled to at most unit length with the component that makes candidates unit long."""
        scaled = rows / self.bound
        rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(axis=1)))
        return np.column_stack([scaled, rest])

    def nearest_lists(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of extended rows, nearest first."""
        far = (self.centroids**2).sum(axis=1)[None, :] - 2 * rows @ self.centroids.T
        n = min(n, len(self.centroids))
        some = np.argpartition(far, n - 1, axis=1)[:, :n]
        order = np.take_along_axis(far, some, 1).argsort(axis=1, kind="stable")
        return np.take_along_axis(some, order, 1)


def centroids_of(rows: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from random distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        nearest = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(1, sizes)[:, None], centres)
    return centres


def fit(vectors: DataFrame, size: int, settings: Settings) -> Geometry:
    """Geometry from usable (vec_id, embedding) rows."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    told = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("bound")).first()
    n, bound = told["n"], told["bound"] or 1.0
    share = min(1.0, settings.sample_rows / max(1, n))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(settings.seed)), F.lit(10**12))
    drawn_rows = vectors.filter(drawn < share * 10**12).select("vec_id", "embedding")
    # ids that repeat are drawn together: of a sample that came out too large the least by hash stay
    small = drawn_rows.orderBy(drawn, "vec_id", "embedding").limit(2 * settings.sample_rows)
    found = small.toArrow().combine_chunks().sort_by("vec_id")
    ids = np.asarray(found.column("vec_id"))
    rows = stacked(found.column("embedding").combine_chunks(), size) if len(ids) else np.zeros((0, size))
    rng = np.random.default_rng(settings.seed)
    rotation, _ = np.linalg.qr(rng.standard_normal((size + 1, size + 1)))
    some = rng.permutation(len(ids))[: settings.bound_rows]
    plain = Geometry(bound, rotation, np.zeros((1, size + 1)), ids[some], rows[some], 1)
    if not len(ids):
        return plain
    lists = max(1, min(settings.most_lists, round(n / settings.list_rows), len(ids) // 8))
    fitted = replace(plain, centroids=centroids_of(plain.extended(rows), lists, settings.seed))
    own = fitted.nearest_lists(fitted.extended(fitted.sample), 1)[:, 0]
    return replace(fitted, probes=probes_needed(fitted, ids, rows, settings), sample_lists=own)


def probes_needed(geometry: Geometry, ids: np.ndarray, rows: np.ndarray, settings: Settings, asked: int = 300) -> int:
    """Lists to probe so that ``recall`` of the sample's neighbours of sampled queries are in them."""
    lists = len(geometry.centroids)
    queries = np.random.default_rng(settings.seed + 1).permutation(len(ids))[:asked]
    k = min(settings.k, len(ids) - 1)
    if lists == 1 or k < 1:
        return lists
    scores = rows[queries] @ rows.T
    scores[ids[queries][:, None] == ids[None, :]] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own = geometry.nearest_lists(geometry.extended(rows), 1)[:, 0]
    order = geometry.nearest_lists(geometry.extended(rows[queries], query=True), lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], 1)
    ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(ranks[math.ceil(settings.recall * len(ranks)) - 1]) + 1


def placed(
    vectors: DataFrame, geometry: Geometry, size: int, settings: Settings, query: bool
) -> DataFrame:
    """Rows with their list; queries once for each list that they probe, with their first bound."""
    rank, batch_rows = settings.spare * settings.k, settings.batch_rows
    shared = vectors.sparkSession.sparkContext.broadcast(geometry)
    probes = geometry.probes if query else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                rows = stacked(part.column(1), size)
                lists = own.nearest_lists(own.extended(rows, query), probes)
                least = np.zeros(len(rows))
                if query:
                    least = first_bounds(own, np.asarray(part.column(0)), rows, lists, rank)
                out = part.take(pa.array(np.repeat(np.arange(len(rows)), lists.shape[1])))
                yield pa.RecordBatch.from_arrays(
                    [out.column(0), out.column(1), pa.array(lists.ravel().astype(np.int32)),
                     pa.array(np.repeat(least, lists.shape[1]))],
                    names=["vec_id", "embedding", "list", "least"],
                )

    return vectors.select("vec_id", "embedding").mapInArrow(
        run, "vec_id bigint, embedding array<double>, list int, least double"
    )


def first_bounds(
    geometry: Geometry, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, rank: int
) -> np.ndarray:
    """The ``rank``-th best score of queries within the sample rows of the lists they probe.

    So many rows that score no less are there to be found, whatever else the lists hold.
    """
    if len(geometry.sample_ids) <= rank:
        return np.full(len(rows), -np.inf)
    probed = np.zeros((len(rows), len(geometry.centroids)), bool)
    np.put_along_axis(probed, lists, True, 1)
    scores = rows @ geometry.sample.T
    scores[~probed[:, geometry.sample_lists]] = -np.inf
    scores[ids[:, None] == geometry.sample_ids[None, :]] = -np.inf
    return -np.partition(-scores, rank - 1, axis=1)[:, rank - 1]


FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Best:
    """The k best (score, id) of each of n queries so far; free places hold -inf."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max))

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge found (query row, score, id) triples."""
        n, k = self.scores.shape
        who = np.concatenate([np.repeat(np.arange(n), k), query])
        all_scores = np.concatenate([self.scores.ravel(), scores])
        all_ids = np.concatenate([self.ids.ravel(), ids])
        order = np.lexsort((all_ids, -all_scores, who))
        who = who[order]
        first = np.searchsorted(who, np.arange(n))
        top = order[(first[:, None] + np.arange(k)[None, :])]
        self.scores, self.ids = all_scores[top], all_ids[top]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        """What was found as rows of query id, id and score."""
        i, j = np.nonzero(self.scores > -np.inf)
        columns = {"query_id": query_ids[i], "vec_id": self.ids[i, j], "score": self.scores[i, j]}
        return pa.RecordBatch.from_pydict(columns)


def scan(
    geometry: Geometry, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
    least: np.ndarray, settings: Settings,
) -> Best:
    """The k best candidates (in ascending order of ids) of each query, by the adaptive scan."""
    turned = geometry.extended(rows) @ geometry.rotation
    asked = geometry.extended(queries, query=True) @ geometry.rotation
    squared = (asked * asked).sum(axis=1)
    columns, step = turned.shape[1], settings.column_block
    ends = [*range(step, columns, step), columns]
    best = Best.of(len(queries), settings.k)

    def allowed(end: int) -> np.ndarray:
        """Partial distance, after ``end`` columns, beyond which a candidate is abandoned, per query."""
        worst = np.maximum(least, best.scores[:, -1])
        limit = squared + 1 - 2 * worst / geometry.bound**2 + 1e-9
        doubt = settings.confidence / math.sqrt(end) if end < columns else 0.0
        return limit * (end / columns) * (1 + doubt) ** 2

    for at in range(0, len(ids), settings.chunk_rows):
        part = turned[at : at + settings.chunk_rows]
        own_ids, own_rows = ids[at : at + settings.chunk_rows], rows[at : at + settings.chunk_rows]
        alive = query_ids[:, None] != own_ids[None, :]
        spans = list(zip([0, *ends[:-1]], ends, strict=True))
        whole = np.zeros(alive.shape)
        while spans and alive.mean() > settings.sparse:  # most are alive: all by one product
            start, end = spans.pop(0)
            q, c = asked[:, start:end], part[:, start:end]
            whole += (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :]
            whole -= (2 * q) @ c.T
            alive &= whole <= allowed(end)[:, None]
        i, j = np.nonzero(alive)
        partial = whole[i, j]
        for start, end in spans:  # few are: each by itself
            gap = asked[i, start:end] - part[j, start:end]
            partial = partial + (gap * gap).sum(axis=1)
            passed = partial <= allowed(end)[i]
            i, j, partial = i[passed], j[passed], partial[passed]
        best.add(i, (queries[i] * own_rows[j]).sum(axis=1), own_ids[j])
    return best


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row that ``is_query`` marks."""
    size = usual_size(vectors)
    spark = vectors.sparkSession
    if not size:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    own = vectors.filter(usable(F.col("embedding"), size) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("_query"),
    )
    geometry = fit(own, size, settings)
    base = settle(placed(own, geometry, size, settings, False), "vector_lists")
    asked = own.filter("_query").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = settle(placed(asked, geometry, size, settings, True), "vector_probes")
    parts = lambda n: F.ceil(n / settings.block_rows).cast("int")
    lists = base.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(
        queries.groupBy(F.col("list").alias("_list")).agg(F.count(F.lit(1)).alias("q")), F.col("list") == F.col("_list")
    )
    dealt = F.broadcast(  # a row for each list, most_lists at most
        lists.select("_list", parts(F.col("n")).alias("_blocks"), parts(F.col("q")).alias("_chunks"))
    )

    def dealt_out(rows: DataFrame, keep: str, spread: str, kept: str, other: str) -> DataFrame:
        """Rows of one side: in one of its own parts, and in all parts of the other side."""
        return rows.join(dealt, rows["list"] == F.col("_list")).select(
            "vec_id", "embedding", "least", "list",
            F.pmod(F.xxhash64("vec_id"), F.col(keep)).cast("int").alias(kept),
            F.explode(F.sequence(F.lit(0), F.col(spread) - 1)).alias(other),
        )

    candidates = dealt_out(base, "_blocks", "_chunks", "block", "chunk")
    probing = dealt_out(queries, "_chunks", "_blocks", "chunk", "block")
    shared = spark.sparkContext.broadcast(geometry)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = Best.of(len(right), settings.k)
        asked = right["vec_id"].to_numpy(np.int64)
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            found = scan(
                shared.value, left["vec_id"].to_numpy(np.int64), np.stack(left["embedding"].to_numpy()),
                asked, np.stack(right["embedding"].to_numpy()), right["least"].to_numpy(), settings,
            )
        return found.batch(asked).to_pandas()

    keys = ("list", "block", "chunk")
    best = candidates.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInPandas(meet, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = (
        best.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= settings.k)
    )
    return ranked.select("query_id", "rank", "vec_id", "score")
