"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Each task encodes its documents and packs them block by block, so nothing is shuffled and tokens are
never stored. A document's cost is estimated as ``linear * n + quadratic * n * n``. Whole sequences
are cut off documents that fill them; what is left is assigned, in descending cost, to the sequence
of the lowest cost that has token capacity left, and cut where it does not fit. A block opens exactly
the capacity that it needs: sequences of full length and, for the remainder, of powers of two, which
need no padding. So there is none, at any block size.

Defined results: a null or empty text is the end-of-document id alone; repeated rows are packed each;
an empty table gives no rows; other columns are ignored. A document may have pieces in several
sequences but never outside its block; one text must fit a task. Sequence ids hold the partition in
the upper bits, so a repeated task gives the same rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytebpe

PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "sequence_tokens bigint"
)


@dataclass(frozen=True)
class Cost:
    """Estimated attention cost of a piece of n tokens."""

    linear: float = 1.0
    quadratic: float = 1.0 / 256

    def __call__(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def capacities(tokens: int, length: int) -> list[int]:
    """Sequences that hold exactly ``tokens``: full ones, then the powers of two of the rest."""
    rest = tokens % length
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [length] * (tokens // length) + powers


def pack(sizes: list[int], length: int, cost: Cost = Cost()) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Pieces (document, start, length, sequence, offset) of a block, and each sequence's tokens."""
    pieces, used = [], []
    for doc, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            pieces.append((doc, start, length, len(used), 0))
            used.append(length)
    rests = sorted(((n % length, doc) for doc, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    first, room = len(used), capacities(sum(n for n, _ in rests), length)
    used += [0] * len(room)
    # A short sequence starts at the cost that its missing capacity would have: it fills up last.
    open_ = [(cost(length) - cost(c), i) for i, c in enumerate(room)]
    heapq.heapify(open_)
    for n, doc in rests:
        start = sizes[doc] - n
        while n:
            spent, i = heapq.heappop(open_)
            take = min(n, room[i] - used[first + i])
            pieces.append((doc, start, take, first + i, used[first + i]))
            used[first + i] += take
            start, n = start + take, n - take
            if used[first + i] < room[i]:
                heapq.heappush(open_, (spent + cost(take), i))
    return pieces, used


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = 1024,
    end_id: int = 0,
    cost: Cost = Cost(),
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per piece; ``block_bytes`` bounds the texts that a task packs together."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(PIECES)])
    end = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab = bytebpe.vocabulary(tokenizer)
        sequence = TaskContext.get().partitionId() << 32

        def packed(names: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal sequence
            pieces, used = pack([len(t) // 4 for t in texts], length, cost)
            pieces.sort()
            crc = [zlib.crc32(memoryview(texts[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            doc, start, size, own, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            totals = np.array([len(t) // 4 for t in texts], np.int64)
            columns = [
                start, size, np.array(crc, np.int64), totals[doc], own + sequence, offset,
                np.array(used, np.int64)[own],
            ]
            ids = pa.array([names[d] for d in doc.tolist()], id_type)
            sequence += len(used)
            arrays = [ids, *(pa.array(c) for c in columns)]
            return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

        names: list = []
        texts: list[bytes] = []
        held, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for at, part in bytebpe.blocks(batch.column(1)):
                found = [vocab.encode(t) + end for t in part]
                names += batch.column(0).slice(at, len(part)).to_pylist()
                texts += found
                held += sum(map(len, found))
                if held >= block_bytes:
                    yield packed(names, texts)
                    names, texts, held = [], [], 0
        if texts:
            yield packed(names, texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
