"""Byte-level BPE from a tokenizer file: splitting into pieces, merging a piece, decoding ids.

A text is split where the file's pattern must have a boundary in any context: before white space that
follows a character other than white space, and around special tokens. What stands between two such
places (a *unit*) is encoded once and looked up from then on, so most of a text costs one dictionary
access per unit. The lookup tables are cleared at a size, which changes speed only.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The file's pattern (public, fixed): contractions, letters, numbers, other signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE = re.compile(r"\s ")
#: Where every text may be cut: ASCII white space after anything but white space.
_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")
#: Longer units, and characters from here on (whose classes differ between Unicode versions), are left
#: to the library itself.
_LONG, _LATER = 500_000, re.compile("[^\x00-\u052f]")
#: Units that can't be merged in one go with others: no space first, other white space, later characters.
_ALONE = re.compile("^(?! [^ ])|[^\x00-\u052f]|[\t-\r\x1c-\x1f\x85\xa0]")


def byte_characters() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary, from the usual rule."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


if sys.byteorder != "little" or array("i").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit numbers")


class Vocabulary:
    """Tokens, special tokens and merging of one tokenizer file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, back = told["model"], byte_characters()
        if model["type"] != "BPE" or told.get("normalizer") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError("merge order and ids differ")
        self.specials = {t["content"]: t["id"] for t in told.get("added_tokens", ())}
        self.tokens: dict[int, bytes] = {
            i: bytes(back[c] for c in t) for t, i in model["vocab"].items() if t not in self.specials
        }
        ranks = {t: i for i, t in self.tokens.items()}
        self.ranks = ranks
        self.line_end = ranks[b"\n"]
        self.tokens |= {i: t.encode() for t, i in self.specials.items()}
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None

    @cached_property
    def merger(self):
        import tiktoken

        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.no_truncation()
        own.no_padding()
        return own

    def merge(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text without special tokens."""
        if len(text) > _LONG or _LATER.search(text):
            return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("i", self.merger.encode_ordinary(text)).tobytes()

    def merge_units(self, units: list[str]) -> list[bytes]:
        """``merge`` of each unit. Most are merged in one call, parted by line ends, which are pieces."""
        out: list[bytes] = [b""] * len(units)
        joint = []
        for i, unit in enumerate(units):
            if _ALONE.search(unit):
                out[i] = self.merge(unit)
            else:
                joint.append(i)
        if joint:
            ids = np.array(self.merger.encode_ordinary("\n".join([units[i] for i in joint])), "<i4")
            flat, ends = ids.tobytes(), (np.flatnonzero(ids == self.line_end) * 4).tolist()
            starts = [0, *(e + 4 for e in ends)]
            for i, a, b in zip(joint, starts, [*ends, len(flat)], strict=True):
                out[i] = flat[a:b]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text, special tokens in it included."""
        if self.special is None or not self.special.search(text):
            return self.merge(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.merge(text[at : m.start()]), array("i", [self.specials[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.merge(text[at:])])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Ids of whole texts by their units. ``resolve`` gives the ids of many new units at once."""

    def __init__(
        self, vocab: Vocabulary, resolve: Callable[[list[str]], list[bytes]] | None = None, most: int = 200_000
    ):
        self.vocab, self.most = vocab, most
        self.resolve = resolve or vocab.merge_units
        self.known: dict[str, bytes] = {}  # by unit without its one space before it
        self.units: dict[str, bytes] = {}  # by whole unit

    def _cut(self, text: str) -> list[str | bytes]:
        """Units of a text with other white space or special tokens; a special token is its id's bytes."""
        special, at, out = self.vocab.special, 0, []
        for m in special.finditer(text) if special else ():
            out += [u for u in _CUT.split(text[at : m.start()]) if u]
            out.append(array("i", [self.vocab.specials[m.group()]]).tobytes())
            at = m.end()
        return out + [u for u in _CUT.split(text[at:]) if u]

    def _uncommon(self, texts: list[str]) -> Iterator[bytes]:
        cut = [self._cut(t) for t in texts]
        if len(self.units) > self.most:
            self.units.clear()
        new = list({u for c in cut for u in c if isinstance(u, str) and u not in self.units})
        self.units.update(zip(new, self.resolve(new), strict=True))
        return iter([b"".join([u if isinstance(u, bytes) else self.units[u] for u in c]) for c in cut])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        special = self.vocab.special
        split = [
            None if _WIDE.search(t) or special and special.search(t) else t.split(" ") for t in texts
        ]
        if len(self.known) > self.most:
            self.known.clear()
        known, units = self.known, set()
        for s in split:
            if s is not None:
                units.update(s[1:])
        new = [u for u in units if u not in known]
        known.update(zip(new, self.resolve([" " + u for u in new]), strict=True))
        heads = self.resolve([s[0] for s in split if s is not None])
        first, others = iter(heads), self._uncommon([t for t, s in zip(texts, split, strict=True) if s is None])
        return [
            next(others) if s is None else b"".join([next(first), *map(known.__getitem__, s[1:])]) for s in split
        ]


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows whose sizes add up to ``most`` or, at least, of one row."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, stop
        at = stop


def blocks(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of runs of rows of about ``most`` bytes; null is the empty text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    for at, stop in spans(sizes, most):
        yield at, [t or "" for t in column.slice(at, stop - at).to_pylist()]
