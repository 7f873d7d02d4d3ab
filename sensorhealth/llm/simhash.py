"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the 64-bit hashes of a text's word shingles. Equal
fingerprints are one row from then on, so copies cost nothing. Two fingerprints that differ in at most
``radius`` bits agree, for any split of the bits into parts with thresholds t_i that satisfy
``sum(t_i + 1) = radius + 1``, in some part up to t_i bits. The split is planned from statistics of all
fingerprints: bits are ordered so that correlated ones share a part, the number of candidate pairs of
each part at each threshold is counted from its values, and a dynamic programme allocates thresholds
at the lowest estimated cost of probes and candidates. Every fingerprint then probes its parts, and
candidates are verified by their Hamming distance.

Buckets larger than ``bucket_rows`` are not joined with themselves: they are dealt into blocks, every
two blocks meet in a task of bounded size, and each row is only connected to the first row that links
reach within the two, not to all of its partners. Components come from rounds of minimum labels over links, in tables of the shared folder.

Defined results: null, empty and word-free texts have fingerprint zero and are linked like any other;
fewer words than a shingle are one shingle; repeated rows get equal rows; a null id is left out of the
minimum that names a component (null if the component has none); an empty table gives no rows; other
columns are ignored. Whole texts are hashed, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .tables import discard, settle

BITS, SEED = 64, 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the hashes of all shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()  # lower-cases and splits at ASCII characters only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[shingle - 1 :] - 1).tolist() or [len(flat)]
    starts = [0, *ends[: len(stops) - 1].tolist()]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(stops), 65536):
        hashes = np.array(
            [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])],
            ">u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits in a signed long."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[int] = []
            for _, texts in bytebpe.blocks(batch.column(1)):
                found += [fingerprint(t, shingle) for t in texts]
            bits = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    """Bits (0 is the lowest) of a part and its threshold; -1 means that the part is not probed."""

    bits: tuple[int, ...]
    threshold: int


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, how often each bit is set, and how often each two bits are, over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.float64)
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1)[:, ::-1].astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_pydict({"n": [n], "both": [both.ravel().astype(np.int64)]})

    told = prints.select("fp").mapInArrow(run, "n bigint, both array<bigint>")
    cells = told.select("n", F.posexplode("both").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    both, n = np.zeros(BITS * BITS), 0
    for r in cells.collect():  # 64 x 64 sums
        both[r["cell"]], n = r["v"], r["n"]
    both = both.reshape(BITS, BITS)
    return n, np.diag(both).copy(), both


def ordered_bits(n: int, ones: np.ndarray, both: np.ndarray) -> list[int]:
    """Bits in an order that keeps strongly correlated ones next to each other."""
    if n < 2:
        return list(range(BITS))
    p = ones / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs((both / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(strength, -1)
    order = [int(np.argmax(strength.max(axis=1)))]
    left = set(range(BITS)) - {order[0]}
    while left:
        nearest = max(left, key=lambda b: (strength[b, order[-4:]].mean(), -b))
        order.append(nearest)
        left.remove(nearest)
    return order


def split_bits(order: list[int], parts: int) -> list[tuple[int, ...]]:
    cuts = np.linspace(0, len(order), parts + 1).round().astype(int)
    return [tuple(sorted(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def mask(bits: tuple[int, ...]) -> int:
    """The bits as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def neighbours(width: int, threshold: int) -> int:
    """Values within ``threshold`` bits of a value of ``width`` bits."""
    return sum(len(list(combinations(range(width), k))) for k in range(threshold + 1)) if threshold >= 0 else 0


def value_pairs(prints: DataFrame, parts: list[tuple[int, ...]]) -> list[float]:
    """Pairs of rows that share a part's whole value, by part, counted over all fingerprints."""
    fp = F.col("fp")
    keyed = prints.select(
        F.posexplode(F.array(*(fp.bitwiseAND(F.lit(mask(p))) for p in parts))).alias("part", "value")
    )
    sizes = keyed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    by_part = {r["part"]: r["pairs"] for r in found.collect()}  # one row per part
    return [by_part.get(i, 0.0) for i in range(len(parts))]


def allocate(parts: list[tuple[int, ...]], exact: list[float], n: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost whose ``t + 1`` add up to ``radius + 1``.

    The cost of a part at threshold t is the probes of all rows plus the candidate pairs, estimated
    as the counted pairs of equal values times the values that a probe covers.
    """

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        around = neighbours(len(parts[i]), t)
        return n * around + exact[i] * around

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(parts)):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, chosen) in best.items():
            for t in range(-1, min(radius, 2) + 1):
                total = used + t + 1
                if total <= radius + 1 and (total not in step or spent + cost(i, t) < step[total][0]):
                    step[total] = (spent + cost(i, t), [*chosen, t])
        best = step
    return best[radius + 1] if radius + 1 in best else (float("inf"), [])


def plan(prints: DataFrame, radius: int = 3) -> list[Part]:
    """The cheapest split, over two parts to one more than the radius."""
    n, ones, both = bit_statistics(prints)
    order = ordered_bits(n, ones, both)
    splits = {m: split_bits(order, m) for m in range(2, radius + 2)}
    exact = value_pairs(prints, [p for parts in splits.values() for p in parts])
    choices, at = [], 0
    for m, parts in splits.items():
        spent, thresholds = allocate(parts, exact[at : at + m], n, radius)
        at += m
        choices.append((spent, m, [Part(p, t) for p, t in zip(parts, thresholds, strict=True)]))
    return min(choices, key=lambda c: c[:2])[2]


def probes(fp: Column, parts: list[Part]) -> Column:
    """(part, value, own) of every value within a part's threshold; ``own`` marks the row's own value."""
    found = []
    for i, part in enumerate(parts):
        for k in range(part.threshold + 1):
            for flips in combinations(part.bits, k):
                value = fp.bitwiseAND(F.lit(mask(part.bits))).bitwiseXOR(F.lit(mask(flips)))
                found.append(
                    F.struct(F.lit(i).alias("part"), value.alias("value"), F.lit(k == 0).alias("own"))
                )
    return F.array(*found)


def _links_in(rows: np.ndarray, others: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between two blocks or, where they are dense, each row with the first row they reach."""
    return connections(np.bitwise_count(rows[:, None] ^ others[None, :]) <= radius, rows, others)


def connections(near: np.ndarray, rows: np.ndarray, others: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what the links of ``near`` connect: all links or, where they are dense, a star."""
    if near.sum() <= len(rows) + len(others):
        i, j = np.nonzero(near)
        keep = rows[i] != others[j]
        return list(zip(rows[i[keep]].view(np.int64).tolist(), others[j[keep]].view(np.int64).tolist(), strict=True))
    a, b = np.arange(len(rows)), np.full(len(others), len(rows) + len(others))
    while True:  # the lowest row index reaches all connected rows of both blocks
        low_b = np.minimum(b, np.where(near, a[:, None], len(rows) + len(others)).min(axis=0))
        low_a = np.minimum(a, np.where(near, low_b[None, :], len(rows) + len(others)).min(axis=1))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    out = [(r, h) for r, h in zip(rows.tolist(), rows[a].tolist(), strict=True) if r != h]
    linked = np.flatnonzero(b < len(rows))
    out += [
        (r, h) for r, h in zip(others[linked].tolist(), rows[b[linked]].tolist(), strict=True) if r != h
    ]
    pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
    return list(map(tuple, pairs.tolist()))


def links(prints: DataFrame, parts: list[Part], radius: int, bucket_rows: int, block_rows: int) -> DataFrame:
    """(a, b): all links of small buckets, and connections that links make in large ones."""
    probed = prints.select("fp", F.explode(probes(F.col("fp"), parts)).alias("_p")).select(
        "fp", F.col("_p.part").alias("part"), F.col("_p.value").alias("value"), F.col("_p.own").alias("own")
    )
    probed = settle(probed, "fingerprint_probes")
    sizes = probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own_n"))
    hot = settle(sizes.filter((F.col("n") > bucket_rows) & (F.col("own_n") > 0)), "fingerprint_hot")
    marked = probed.join(hot.select("part", "value", "n"), ["part", "value"], "left")
    cold = marked.filter("n is null")
    left = cold.filter("own").select(F.col("fp").alias("a"), "part", "value")
    right = cold.select(F.col("fp").alias("b"), "part", "value", F.col("own").alias("_own"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["part", "value"]).filter(
        (F.col("a") != F.col("b")) & (~F.col("_own") | (F.col("a") < F.col("b"))) & (apart <= radius)
    )
    # large buckets: block x of a bucket meets every block y >= x
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    dealt = marked.filter("n is not null").select(
        "fp", "part", "value", blocks.alias("_blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("_own")
    )
    meets = dealt.select(
        "fp", "part", "value", "_own",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("_blocks") - 1),
                lambda o: F.struct(F.least(o, F.col("_own")).alias("x"), F.greatest(o, F.col("_own")).alias("y")),
            )
        ).alias("_m"),
    ).select("fp", "part", "value", "_own", "_m.x", "_m.y")

    def met(group: pd.DataFrame) -> pd.DataFrame:
        own = group["_own"].to_numpy()
        fps = group["fp"].to_numpy().view(np.uint64)
        x, y = group["x"].iloc[0], group["y"].iloc[0]
        found = _links_in(np.unique(fps[own == x]), np.unique(fps[own == y]), radius)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    spanning = meets.groupBy("part", "value", "x", "y").applyInPandas(met, "a bigint, b bigint")
    found = settle(pairs.select("a", "b").unionAll(spanning).distinct(), "fingerprint_links")
    discard(probed)
    discard(hot)
    return found


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that links reach, by alternating star contraction.

    A round points every node at the smallest node it knows, first the larger neighbours and then
    the smaller ones, until no link changes; paths halve, so rounds grow with their logarithm and
    ``most_rounds`` of them, beyond which this raises, are enough for 2 ** 60 nodes.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        e.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )

    def least_of(e: DataFrame) -> DataFrame:
        # written, so that the join below reads two plain shuffles: only then is a node that many
        # links name split by adaptive execution
        least = settle(e.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")), "component_least")
        scratch.append(least)
        return least

    def large_star(e: DataFrame) -> DataFrame:
        near = both(e)
        least = least_of(near)
        m = F.least("_m", "u")
        return (
            near.join(least, near["u"] == least["_u"])
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("a"), m.alias("b"))
        )

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
        least = least_of(down)
        rows = down.join(least, down["u"] == least["_u"])
        return rows.select(F.col("v").alias("a"), F.col("_m").alias("b")).unionAll(
            least.select(F.col("_u").alias("a"), F.col("_m").alias("b"))
        )

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    scratch: list[DataFrame] = []
    now = settle(edges.select("a", "b").filter("a != b").distinct(), "component_links")
    before = told(now)
    for _ in range(most_rounds):
        wide = settle(large_star(now), "component_wide")
        after = settle(small_star(wide).filter("a != b").distinct(), "component_links")
        for done in (now, wide, *scratch):
            discard(done)
        scratch.clear()
        now, state = after, told(after)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, bucket_rows: int = 512, block_rows: int = 2048
) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component's id is its smallest document."""
    return grouped(settle(fingerprints(docs, shingle), "fingerprints"), radius, bucket_rows, block_rows)


def grouped(own: DataFrame, radius: int = 3, bucket_rows: int = 512, block_rows: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) of written rows (doc_id, fp); see ``near_duplicates``."""
    prints = settle(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprint_classes")
    distinct = prints.select("fp")
    labels = components(links(distinct, plan(distinct, radius), radius, bucket_rows, block_rows))
    named = prints.join(labels, prints["fp"] == labels["node"], "left").select(
        "fp", "doc_id", F.coalesce("label", "fp").alias("label")
    )
    least = named.groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("component_id"))
    classes = settle(
        named.join(least, named["label"] == least["_label"]).select(F.col("fp").alias("_fp"), "component_id"),
        "fingerprint_components",
    )
    discard(prints)
    return own.join(classes, own["fp"] == classes["_fp"], "left").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
