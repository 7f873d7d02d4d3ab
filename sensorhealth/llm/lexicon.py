"""Encoding and decoding through a minimal acyclic transducer of frequent words.

Words are counted over all documents, the most frequent ones (a bounded number) are compiled into one
automaton that shares prefixes and suffixes, and every arc carries the number of words that sort
before it, so the sum along a path is the word's number, which points at its ids. The automaton is a
flat file: Spark sends it to the executors, where all workers map the same pages. Words that the automaton
does not accept are merged exactly, so results never depend on the lexicon.

Defined results: null and empty texts have no ids and decode to the empty text; special tokens of the
file inside a text become their ids; repeated rows give equal rows; an empty table gives an empty
lexicon and no rows; other columns are ignored. Texts are encoded whole, in blocks of bounded bytes;
one text must fit a task.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .tables import discard, settle

#: Words of the lexicon at most, and the longest word (code points) that enters it.
LEXICON_WORDS, LONGEST = 150_000, 40


def build(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted distinct words as arrays of arcs.

    ``key`` is state * 256 + byte in ascending order, ``target`` the next state, ``before`` how many
    words of the source state sort before the arc; ``final`` marks accepting states. State 0 is the
    start.
    """
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def frozen(final: bool, arcs: list[tuple[int, int]]) -> int:
        signature = (final, tuple(arcs))
        state = register.get(signature)
        if state is None:
            state = register[signature] = len(nodes)
            nodes.append(signature)
        return state

    # the path of the last word: [final, finished arcs, byte of the arc that is still open]
    path: list[list] = [[False, [], -1]]
    last = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], frozen(final, arcs)))

    for word in words:
        common = len(os.path.commonprefix([last, word]))
        fold(common)
        for byte in word[common:]:
            path[-1][2] = byte
            path.append([False, [], -1])
        path[-1][0] = True
        last = word
    fold(0)
    root = frozen(path[0][0], path[0][1])
    order = [root, *(s for s in range(len(nodes)) if s != root)]
    number = {s: i for i, s in enumerate(order)}
    words_in = [0] * len(nodes)
    for s, (final, arcs) in enumerate(nodes):  # children are frozen before their parents
        words_in[s] = final + sum(words_in[t] for _, t in arcs)
    key, target, before = [], [], []
    for s in order:
        final, arcs = nodes[s]
        seen = int(final)
        for byte, t in sorted(arcs):
            key.append(number[s] * 256 + byte)
            target.append(number[t])
            before.append(seen)
            seen += words_in[t]
    final = np.array([nodes[s][0] for s in order], np.uint8)
    return {
        "key": np.array(key, np.int64),
        "target": np.array(target, np.int32),
        "before": np.array(before, np.int32),
        "final": final,
    }


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays after one line that tells their places."""
    told, at = {}, 0
    for name, a in arrays.items():
        told[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(told).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))


class Lexicon:
    """A saved automaton with the ids of its words, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        told = json.loads(head)
        self.arrays = {
            n: np.memmap(path, dtype, "r", len(head) + at, (size,)) if size else np.zeros(0, dtype)
            for n, (dtype, size, at) in told.items()
        }

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, or -1; all words walk the automaton side by side."""
        a, n = self.arrays, len(words)
        key, target, before, final = a["key"], a["target"], a["before"], a["final"]
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        state, number = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = np.flatnonzero(size > 0) if len(key) else np.zeros(0, np.int64)
        out = np.full(n, -1, np.int64)
        if len(final) and final[0]:
            out[size == 0] = 0
        step = 0
        while len(alive):
            wanted = state[alive] * 256 + flat[start[alive] + step]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = key[at] == wanted
            alive, at = alive[hit], at[hit]
            state[alive] = target[at]
            number[alive] += before[at]
            step += 1
            ended = size[alive] == step
            done = alive[ended]
            done = done[final[state[done]] == 1]
            out[done] = number[done]
            alive = alive[~ended]
        return out

    def ids(self, numbers: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of the words with these numbers."""
        flat, ends = memoryview(np.asarray(self.arrays["ids"])).cast("B"), self.arrays["ends"]
        places = zip((ends[numbers] * 4).tolist(), (ends[numbers + 1] * 4).tolist(), strict=True)
        return [bytes(flat[a:b]) for a, b in places]


def word_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, n) over all documents; each task sends its sums whenever it holds ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict(
                {"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())}
            )
            seen.clear()
            return out

        for batch in batches:
            for _, texts in bytebpe.blocks(batch.column(0)):
                for text in texts:
                    seen.update(text.split())
                if len(seen) > most:
                    yield rows()
        if seen:
            yield rows()

    counted = docs.select("text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int = LEXICON_WORDS) -> list[str]:
    """The ``size`` words of the largest counts; of equally frequent ones those that sort first.

    A histogram over levels of counts (a few hundred, whatever the counts) tells which levels are taken
    whole; only words of the one level that is taken in part are ordered.
    """
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    counts = settle(word_counts(docs).filter(F.length("word") <= LONGEST).select("*", level), "word_counts")
    histogram = counts.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect()
    room, whole, part = size, [], None
    for at, words in sorted(((r["level"], r["words"]) for r in histogram), reverse=True):
        if words > room:
            part = at
            break
        room -= words
        whole.append(at)
    chosen = counts.filter(F.col("level").isin(whole)) if whole else counts.limit(0)
    if part is not None and room:
        chosen = chosen.unionAll(counts.filter(F.col("level") == part).orderBy(F.desc("n"), "word").limit(room))
    words = [r["word"] for r in chosen.select("word").collect()]
    discard(counts)
    return words


def compile_lexicon(words: list[str], vocab: bytebpe.Vocabulary, path: str) -> None:
    """Write the automaton of the words, each with the space before it, and their ids."""
    ordered = sorted({(" " + w).encode(): " " + w for w in words}.items())
    ids = vocab.merge_units([w for _, w in ordered])
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    arrays = build([w for w, _ in ordered])
    arrays |= {"ids": np.frombuffer(b"".join(ids), "<i4"), "ends": ends}
    save(path, arrays)


def share_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the documents' lexicon and send it to the executors; its name among Spark's files."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    compile_lexicon(frequent_words(docs, size), bytebpe.vocabulary(tokenizer), path)
    docs.sparkSession.sparkContext.addFile(path)
    return name


def resolver(lexicon: Lexicon, vocab: bytebpe.Vocabulary):
    """Ids of words: known ones from the automaton, the others merged."""

    def resolve(units: list[str]) -> list[bytes]:
        numbers = lexicon.find([u.encode() for u in units])
        out: list[bytes] = [b""] * len(units)
        hit, unseen = np.flatnonzero(numbers >= 0), np.flatnonzero(numbers < 0).tolist()
        for i, ids in zip(hit.tolist(), lexicon.ids(numbers[hit]), strict=True):
            out[i] = ids
        for i, ids in zip(unseen, vocab.merge_units([units[i] for i in unseen]), strict=True):
            out[i] = ids
        return out

    return resolve


def encode(docs: DataFrame, lexicon_file: str, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bytebpe.vocabulary(tokenizer)
        encoder = bytebpe.Encoder(vocab, resolver(Lexicon(SparkFiles.get(lexicon_file)), vocab))
        for batch in batches:
            for at, texts in bytebpe.blocks(batch.column(1)):
                found = encoder.encode(texts)
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) from ids."""
    schema = T.StructType([*encoded.select("doc_id", "ids").schema, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bytebpe.vocabulary(tokenizer)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
            for at, stop in bytebpe.spans(sizes, 1 << 20):
                part = lists.slice(at, stop - at)
                ids = np.asarray(part.flatten())
                ends = np.cumsum([0, *sizes[at:stop]])
                texts = [
                    vocab.decode(ids[a:b].tolist()).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, stop - at), part, pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "text"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
