"""Near copies by the similarity of word shingles: texts whose sets have a Jaccard similarity of 0.8 or more.

A text is the set of hashes of its shingles of five words. Equal sets are one row from then on, so copies
cost nothing. SimHash goes first: sets whose fingerprints ``simhash.grouped`` brings into one component are
compared with the component's least set, and those that are similar are one class from then on. Replaced
words move more bits than fingerprints may differ in, so MinHash values in bands propose the rest, between
classes only: texts of a similarity s share one of ``BANDS`` bands of ``ROWS`` values with probability
``1 - (1 - s ** ROWS) ** BANDS``, so that at 0.8 less than one pair of ten million is not proposed. Every
candidate of either is verified on the whole sets.

Buckets of up to ``bucket_rows`` texts are joined with themselves. In larger ones every text first meets
its buckets' hubs: the text that shares most buckets with others, then, round by round, texts drawn by hash.
What these links connect is one class from then on, and only texts outside the largest class of their crowd
(large buckets that share texts) go on. Rounds end when few are left or a round connects few; those left
meet their whole crowd, block by block in tasks of bounded size, where texts of one class are not compared.
So copies of one page cost a few comparisons each, however many they are; texts that share bands but are
seldom similar cost the product of their numbers. Components come from ``simhash.components``.

Defined results: null and word-free texts have the empty set and are copies of each other; fewer words
than a shingle are one shingle; one row of each component stays, whether ids repeat, clash or are null:
that of the smallest id (null if there is no other), of these that of the smallest set hash, then the least row; an empty
table gives no rows; columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .simhash import SEED, components, fingerprint, grouped
from .tables import discard, settle

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
#: Rounds of drawn hubs at most, and the share of texts left from which a round was not worth it.
ROUNDS, PROGRESS = 6, 0.8
#: Bits of the table of set hashes that keeps other texts' sets out of the verification.
WANTED = 23

_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's runs of ``size`` words."""
    import xxhash

    words = text.encode().lower().split()  # lower-cases and splits at ASCII characters only
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = max(min(1, len(own)), len(own) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(own))):
        out = _mixed(out * _STEP + own[k : k + n])
    return np.unique(out)


def set_hash(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (np.multiply.outer(_TIMES, hashes[at : at + 2048]) + _PLUS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for values in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + values)
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, set, keys, fp) of every row."""
    own = T._parse_datatype_string("set bigint, keys array<bigint>, fp bigint")
    schema = T.StructType([docs.schema["doc_id"], *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in bytebpe.blocks(batch.column(1)):
                sets = [shingles(t) for t in texts]
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([set_hash(s) for s in sets], pa.int64()), keys, pa.array(prints)],
                    names=["doc_id", "set", "keys", "fp"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def hashes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, hashes) of the wanted sets, computed anew from one text of each."""
    cell = F.shiftrightunsigned("set", 64 - WANTED)
    bits = wanted.select((cell / 32).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(set, {64 - WANTED}) % 32 as int))").alias("bit"))
    table = np.zeros(1 << (WANTED - 5), np.uint32)
    for r in bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # 2 ** 18 rows at most
        table[r["at"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in bytebpe.blocks(batch.column(0)):
                found: dict[int, bytes] = {}
                for hashes in map(shingles, texts):
                    own = set_hash(hashes)
                    at = (own % (1 << 64)) >> (64 - WANTED)
                    if int(shared.value[at // 32]) >> at % 32 & 1:
                        found[own] = hashes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], names=["set", "hashes"]
                )

    return (
        docs.select("text").mapInArrow(run, "set bigint, hashes binary")
        .join(wanted, "set", "left_semi").groupBy("set").agg(F.min("hashes").alias("hashes"))
    )


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda k: sets.select(F.col("set").alias(k), F.col("hashes").alias(f"_{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def similar(rows: list[np.ndarray], others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``rows`` are similar to which of ``others``, by shared hashes in an inverted table."""
    sizes = np.array([len(o) for o in others])
    flat, owner = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    near = np.zeros((len(rows), len(others)), bool)
    for i, row in enumerate(rows):
        first, n = np.searchsorted(flat, row), np.searchsorted(flat, row, "right")
        n -= first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(others))
        near[i] = both >= similarity * (len(row) + sizes - both) - 1e-9
    return near


def crowd_links(members: DataFrame, sets: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """(a, b): connections between the classes of each group of (set, group, label, few).

    The few texts outside the largest class of their group meet every text of the group.
    """
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block_rows)).cast("int")
    open_ = (
        members.groupBy(F.col("group").alias("_g"))
        .agg(parts(F.count(F.lit(1))).alias("_blocks"), F.count_if("few").alias("_few"))
        .filter("_few > 0")
        .select("_g", "_blocks", parts(F.col("_few")).alias("_chunks"))
    )
    dealt = members.join(open_, members["group"] == open_["_g"]).drop("_g")

    def side(rows: DataFrame, own: str, other: str, few: bool) -> DataFrame:
        """Ids of one side: in one of its own parts, and in all parts of the other side."""
        place = F.pmod(F.xxhash64("set"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        block, chunk = (every, place) if few else (place, every)
        return rows.select("set", "label", "group", F.lit(few).alias("few"), block.alias("block"), chunk.alias("chunk"))

    few = side(dealt.filter("few"), "_chunks", "_blocks", True)
    meets = few.unionAll(side(dealt, "_blocks", "_chunks", False)).join(sets, "set")

    def met(group: pd.DataFrame) -> pd.DataFrame:
        few, labels = group["few"].to_numpy(), group["label"].to_numpy()
        hashes = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        at = [np.flatnonzero(few), np.flatnonzero(~few)]
        found: list = []
        if len(at[0]) and len(at[1]):
            near = similar(*([hashes[i] for i in side] for side in at), similarity)
            near &= labels[at[0]][:, None] != labels[at[1]][None, :]
            i, j = np.nonzero(near)
            # two classes are connected by any of their links
            between = np.sort(np.column_stack([labels[at[0]][i], labels[at[1]][j]]), axis=1)
            found = [tuple(p) for p in np.unique(between, axis=0).tolist()]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return meets.groupBy("group", "block", "chunk").applyInPandas(met, "a bigint, b bigint")


def _as_pairs(stars: DataFrame) -> DataFrame:
    """(a, b) with a < b from (set, hub)."""
    apart = stars.filter("set != hub")
    return apart.select(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``labels`` (node, label) do not put into one class."""
    of = lambda k: labels.select(F.col("node").alias(f"_n{k}"), F.col("label").alias(f"_l{k}"))
    told = pairs.join(of("a"), F.col("a") == F.col("_na"), "left").join(of("b"), F.col("b") == F.col("_nb"), "left")
    return told.filter(F.coalesce("_la", "a") != F.coalesce("_lb", "b")).select("a", "b")


def _classes(crowds: DataFrame, found: DataFrame) -> DataFrame:
    """(set, group, label, few): the class of each member of a crowd, and whether it is not the largest."""
    linked = components(found)
    named = settle(
        crowds.join(linked.withColumnRenamed("label", "class"), F.col("set") == F.col("node"), "left")
        .select("set", "group", F.coalesce("class", "set").alias("label")),
        "copy_classes_of_crowds",
    )
    sizes = named.groupBy("group", "label").agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.groupBy(F.col("group").alias("_g")).agg(F.max(F.struct("_n", "label"))["label"].alias("_largest"))
    marked = named.join(top, named["group"] == top["_g"]).select(
        "set", "group", "label", (F.col("label") != F.col("_largest")).alias("few")
    )
    return settle(marked, "copy_members")


def links(docs: DataFrame, classes: DataFrame, similarity: float, bucket_rows: int, block_rows: int) -> DataFrame:
    """(a, b): links and connections of similar sets among the (set, keys, fp) of ``classes``."""
    prints = settle(classes.select(F.col("set").alias("doc_id"), "fp"), "copy_fingerprints")
    near = grouped(prints).select(F.col("doc_id").alias("set"), F.col("component_id").alias("hub"))
    near = settle(_as_pairs(near), "copy_near")
    bands = classes.select("set", F.explode("keys").alias("key"))
    met = bands.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = settle(bands.join(met, bands["key"] == met["_key"]).select("set", "key", "n"), "copy_buckets")
    small = shared.filter(F.col("n") <= bucket_rows).select("set", "key")
    sides = [small.select(F.col("set").alias(k), "key") for k in "ab"]
    pairs = sides[0].join(sides[1], "key").filter("a < b").select("a", "b")
    # the text that is in most company is each large bucket's first hub
    large = shared.filter(F.col("n") > bucket_rows)
    weights = large.groupBy("set").agg(F.sum("n").alias("weight"))
    ranked = settle(large.select("set", "key").join(weights, "set"), "copy_large")

    def stars_of(rows: DataFrame, order: Column) -> DataFrame:
        """(set, hub): rows of (set, key) with the hubs of their buckets."""
        hubs = ranked.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct(order, "set"))["set"].alias("hub"))
        return rows.join(hubs, rows["key"] == hubs["_key"]).select("set", "hub").distinct()

    stars = settle(stars_of(ranked, F.col("weight")), "copy_stars")
    pairs = settle(pairs.unionAll(_as_pairs(stars)).distinct(), "copy_pairs")
    both = near.unionAll(pairs)
    wanted = both.select(F.col("a").alias("set")).unionAll(both.select("b")).distinct()
    wanted = settle(wanted, "copy_wanted")
    sets = settle(hashes_of(docs, wanted), "copy_sets")
    alike = settle(verified(near, sets, similarity), "copy_alike")
    found = settle(alike.unionAll(verified(_between(pairs, components(alike)), sets, similarity)), "copy_links")
    done = [prints, near, shared, ranked, stars, pairs, wanted, sets, alike]
    if not stars.isEmpty():
        crowded = components(stars.select(F.col("set").alias("a"), F.col("hub").alias("b")))
        own = stars.select("set").distinct()
        crowds = settle(
            own.join(crowded, own["set"] == crowded["node"], "left").select("set", F.coalesce("label", "set").alias("group")),
            "copy_crowds",
        )
        members = _classes(crowds, found)
        few = members.filter("few").count()
        for round_ in range(1, ROUNDS + 1):
            if few <= block_rows:
                break
            left = ranked.select("set", "key").join(members.filter("few").select("set"), "set", "left_semi")
            drawn = stars_of(left, F.xxhash64("set", "key", F.lit(round_)))
            fresh = verified(_as_pairs(drawn), sets, similarity)
            found, before = settle(found.unionAll(fresh).distinct(), "copy_links"), few
            members = _classes(crowds, found)
            few = members.filter("few").count()
            if few > before * PROGRESS:
                break
        more = crowd_links(members, sets, similarity, block_rows)
        found = settle(found.unionAll(more).distinct(), "copy_all_links")
        done += [crowds, members]
    for table in done:
        discard(table)
    return found


def keep_first(
    docs: DataFrame, similarity: float = SIMILARITY, bucket_rows: int = 32, block_rows: int = 256
) -> DataFrame:
    """One row of each component of near copies stays, with its columns as they are."""
    own = settle(signatures(docs), "copy_signatures")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    classes = settle(own.groupBy("set").agg(F.min(order).alias("first"), F.any_value("keys").alias("keys"), F.min("fp").alias("fp")), "copy_classes")
    labels = components(links(docs, classes, similarity, bucket_rows, block_rows))
    named = classes.join(labels, classes["set"] == labels["node"], "left").select(
        F.coalesce("label", "set").alias("label"), F.struct("first", "set").alias("first")
    )
    firsts = named.groupBy("label").agg(F.min("first").alias("first")).select(
        F.col("first.set").alias("_first_set"), F.col("first.first.id").alias("_first_id")
    )
    rows = own.groupBy(F.col("set").alias("_s"), F.col("doc_id").alias("_i")).agg(F.count(F.lit(1)).alias("_rows"))
    firsts = settle(
        firsts.join(rows, (F.col("_first_set") == F.col("_s")) & F.col("_first_id").eqNullSafe(F.col("_i")))
        .select("_first_set", "_first_id", "_rows"),
        "copy_firsts",
    )
    discard(own)
    discard(classes)
    return _rows_of(docs, firsts)


def _with_sets(docs: DataFrame) -> DataFrame:
    """(_set, _row): the rows with the hashes of their sets."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    schema = T.StructType([T.StructField("_set", T.LongType()), *row.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for at, texts in bytebpe.blocks(pa.compute.struct_field(rows, "text")):
                found = pa.array([set_hash(shingles(t)) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([found, rows.slice(at, len(texts))], names=["_set", "_row"])

    return row.mapInArrow(run, schema)


def _rows_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    rows = _with_sets(docs)

    def of(kept: DataFrame) -> DataFrame:
        # sets grow with the documents: both sides are dealt out at every size, none is broadcast
        same: Column = (F.col("_set") == F.col("_first_set")) & F.col("_row.doc_id").eqNullSafe(F.col("_first_id"))
        return rows.join(kept.hint("merge"), same, "left_semi")

    once = of(firsts.filter("_rows = 1")).select("_row")
    if not firsts.filter("_rows > 1").isEmpty():
        again = of(firsts.filter("_rows > 1")).groupBy("_set").agg(F.min("_row").alias("_row"))
        once = once.unionAll(again.select("_row"))
    return once.select("_row.*")
