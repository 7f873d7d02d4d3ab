import numpy as np
import pytest
import xxhash

from sensorhealth.llm import simhash


def slow_print(text, k=3):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=3):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[top(b)] = top(a)
    return [top(v) for v in prints]


def test_fingerprints(spark, docs, odd_rows):
    rows = [*odd_rows, (40, "Ä Ä A a"), (41, "two words"), (42, "a\x0bb\x1cc\x85d e f g")]
    got = simhash.fingerprints(docs(rows)).collect()
    want = sorted((i or 0, slow_print(t)) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["fp"] % (1 << 64)) for r in got) == want


def dense(rng, n):
    """A chain of near fingerprints, all in the same buckets."""
    out, at = [], int(rng.integers(0, 1 << 62))
    for _ in range(n):
        at ^= 1 << int(rng.integers(0, 20))
        out.append(at)
    return out


@pytest.mark.parametrize("bucket_rows,block_rows", [(512, 2048), (20, 16)])
def test_links_and_components(spark, bucket_rows, block_rows):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 400)]
    near = [b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base]
    prints = list(set(base + near + dense(rng, 300) + [0, (1 << 64) - 1]))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = simhash.links(table, simhash.plan(table), 3, bucket_rows, block_rows)
    for r in edges.collect() if bucket_rows > 400 else ():  # large buckets give connections, not links
        assert ((r["a"] ^ r["b"]) % (1 << 64)).bit_count() <= 3
    label = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    found = [label.get(s, s) for s in signed]
    want = classes(prints)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_plan_satisfies_the_principle(spark):
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2, (2000, 1)).repeat(10, axis=1)  # ten bits that always agree
    bits = np.hstack([shared, rng.integers(0, 2, (2000, 54))])
    values = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1).view(np.int64)
    table = spark.createDataFrame([(int(v),) for v in values], "fp bigint")
    parts = simhash.plan(table, 3)
    assert sum(p.threshold + 1 for p in parts) == 4
    assert sorted(b for p in parts for b in p.bits) == list(range(64))
    assert any(set(range(10)) <= set(p.bits) for p in parts)
    cost, thresholds = simhash.allocate([tuple(range(40)), tuple(range(40, 64))], [10.0, 1e9], 1000, 3)
    assert thresholds[0] > thresholds[1] and sum(t + 1 for t in thresholds) == 4


def test_components_of_odd_rows(spark, docs, odd_rows):
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [*odd_rows, (50, text), (49, text), (51, text.replace("w2999", "x")), (52, "another text altogether"), (None, text)]
    table = docs(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table).collect() if r["doc_id"]}
    assert got[1] == got[2] == got[3] == 1 and got[50] == got[49] == got[51] == 49 and got[52] == 52
    assert simhash.near_duplicates(docs([])).collect() == []
