import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sensorhealth.llm import bytebpe, lexicon, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


BITS = [*"abé ß1.\n\t'sd 中ж<|", "<|endoftext|>", " the", "  ", "\u3000"]
TEXT = st.lists(st.sampled_from(BITS), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_encoder_equals_the_library(texts):
    vocab = bytebpe.vocabulary(PATH)
    want = [vocab.library.encode(t, add_special_tokens=False).ids for t in texts]
    for found in (bytebpe.Encoder(vocab).encode(texts), [vocab.encode(t) for t in texts]):
        assert [np.frombuffer(b, "<i4").tolist() for b in found] == want
    assert [vocab.decode(w).decode() for w in want] == texts


def test_every_text_goes_through_the_units():
    vocab, met = bytebpe.vocabulary(PATH), []

    def resolve(units):
        met.extend(units)
        return vocab.merge_units(units)

    texts = ["a  b\n\n  c<|endoftext|> d\t\te <|endoftext|><|endoftext|>", " x" * 300_000 + "  y", "\n", " \t ", "中文  中文\u3000 中"]
    got = bytebpe.Encoder(vocab, resolve).encode(texts)
    want = [vocab.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<i4").tolist() for b in got] == want
    assert max(map(len, met)) < 12 and {"  b", "\n\n  c", "\t\te", " d", "  y", " x"} <= set(met)


def test_the_most_frequent_words_are_chosen(spark, docs):
    rows = [(i, " ".join(f"w{k:02}" for k in range(40) for _ in range(60 if k < 12 else 1 + k % 4))) for i in range(3)]
    counts = {f"w{k:02}": 3 * (60 if k < 12 else 1 + k % 4) for k in range(40)}
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    for size in (0, 5, 12, 17, 40, 100):
        assert sorted(lexicon.frequent_words(docs(rows), size)) == sorted(ranked[:size])


def test_classes_of_all_characters():
    vocab = bytebpe.vocabulary(PATH)
    rows = [f"a{c}b {c}{c} 1{c} .{c}'s {c}  {c} x" for c in map(chr, range(0, 0x30000, 3)) if not "\ud800" <= c <= "\udfff"]
    want = [x.ids for x in vocab.library.encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(b, "<i4").tolist() for b in bytebpe.Encoder(vocab).encode(rows)] == want


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_automaton_numbers_its_words(words, others):
    import tempfile

    ordered = sorted(words)
    with tempfile.NamedTemporaryFile() as f:
        none = {"ids": np.zeros(0, np.int32), "ends": np.zeros(1, np.int64)}
        lexicon.save(f.name, lexicon.build(ordered) | none)
        found = lexicon.Lexicon(f.name)
        assert found.find(ordered).tolist() == list(range(len(ordered)))
        assert found.find(others).tolist() == [ordered.index(w) if w in words else -1 for w in others]


def test_automaton_is_minimal():
    arrays = lexicon.build(sorted(p + s for p in (b"a", b"b", b"ccc") for s in (b"ing", b"ed", b"")))
    # start, two inside ccc, one state after every stem, i-n, in-g, e-d, end
    assert len(arrays["final"]) == 8


def test_lexicon_operator(spark, docs, odd_rows, library):
    table = docs(odd_rows)
    for size in (1000, 0):
        encoded = lexicon.encode(table, lexicon.share_lexicon(table, PATH, size), PATH)
        rows = lexicon.decode(encoded, PATH).collect()
        got = sorted((r["doc_id"] or 0, r["ids"], r["text"]) for r in rows)
        assert got == sorted((i or 0, library(t), t or "") for i, t in odd_rows)
    none = docs([])
    assert lexicon.encode(none, lexicon.share_lexicon(none, PATH), PATH).collect() == []


def test_packing_operator(spark, docs, odd_rows, library):
    texts = [(i, t) for i, t in odd_rows if i != 4] + [(4, odd_rows[3][1]), (None, None)]
    rows = packing.pack_documents(docs(texts).repartition(3), PATH).collect()
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append([*library(t), 0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in ids.items():
        for tokens in own:
            at = 0
            for r in sorted(by_doc[(i, len(tokens))], key=lambda r: r["start"]):
                assert r["start"] == at
                part = np.array(tokens[at : at + r["length"]], "<u4")
                assert r["ids_crc32"] == zlib.crc32(part.tobytes())
                at += r["length"]
            assert at == len(tokens)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == r["sequence_tokens"] <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack_documents(docs([]), PATH).collect() == []


def test_packing_balances_cost():
    rng, cost = random.Random(5), packing.Cost()
    sizes = [int(2 ** rng.uniform(0, 8.2)) for _ in range(6000)]
    pieces, used = packing.pack(sizes, 1024, cost)
    assert sum(p[2] for p in pieces) == sum(sizes) == sum(used)
    spent = defaultdict(float)
    for _, _, n, s, _ in pieces:
        spent[s] += cost(n)
    full = [spent[s] for s, n in enumerate(used) if n == 1024]
    filled, at = defaultdict(float), 0
    for n in sorted(sizes, reverse=True):  # one sequence after the other
        while n:
            take = min(n, 1024 - at % 1024)
            filled[at // 1024] += cost(take)
            at, n = at + take, n - take
    assert np.std(full) < 0.5 * np.std(list(filled.values()))
    assert len(pieces) < len(sizes) + len(used)
