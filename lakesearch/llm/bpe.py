"""Byte-level BPE encoding with the merges of a public rank file.

A text is parted by the tokenizer's pattern; each piece's UTF-8 bytes, mapped to Latin-1, run once through an
Aho-Corasick automaton of the vocabulary, which gives the longest token at every byte. The ids follow by taking longest
tokens from the left and stepping back to shorter ones: a token may follow another only if the merges would have
produced just these two side by side, a fact of the pair alone that is memoised. Every end position fails at most once,
so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lakesearch.sources.workers import ship, spread

#: Where the public vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that the rank files are made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without the characters of ODD, in the faster standard module.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Entries that a worker's piece cache and pair memo may hold before they start afresh.
CACHED = 400_000


def _odd() -> re.Pattern:
    """Characters that the two patterns class differently: numbers that are no decimal digits, and control separators."""
    codes = [c for c in range(sys.maxunicode + 1) if c in range(0x1C, 0x20) or unicodedata.category(chr(c)) in ("Nl", "No")]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]")


class Encoder(dict):
    """Piece (str) -> tuple of ids, filled as pieces are met."""

    def __init__(self, file: str):
        super().__init__()
        import ahocorasick
        import regex

        with open(file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = {i: w for w, i in self.ranks.items()}
        self.lengths = {i: len(w) for i, w in self.words.items()}
        self.joined: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        for i, w in sorted(self.words.items()):
            for n in range(len(w) - 1, 0, -1):
                if (p := self.ranks.get(w[:n])) is not None:
                    self.shorter[i] = p
                    break
            if len(w) > 1:
                self.parts[i] = a, b = self._halves(w, i)
                self.joined[a << 20 | b] = i
        self.fits: dict[int, bool] = {}
        self.trie = ahocorasick.Automaton()
        for w, i in self.ranks.items():
            self.trie.add_word(w.decode("latin-1"), (i, len(w)))
        self.trie.make_automaton()
        self.odd, self.plain, self.full = _odd(), re.compile(PLAIN), regex.compile(PATTERN)

    def _halves(self, word: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes `word`."""
        ranks = self.ranks
        cuts = [(a, b) for n in range(1, len(word)) if (a := ranks.get(word[:n], rank)) < rank and (b := ranks.get(word[n:], rank)) < rank]
        if len(cuts) == 1:
            return cuts[0]
        row = [word[i : i + 1] for i in range(len(word))]
        while len(row) > 2:
            best = min(range(len(row) - 1), key=lambda i: ranks.get(row[i] + row[i + 1], rank))
            row[best : best + 2] = [row[best] + row[best + 1]]
        return ranks[row[0]], ranks[row[1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both together leaves exactly these two tokens.

        Takes back the merges of both, latest first. If at any stage the tokens that touch at the seam would merge
        before the merge just taken back, the seam would not have survived.
        """
        bound = 1 << 30
        while True:
            if self.joined.get(left << 20 | right, bound) < bound:
                return False
            # of the two, the token of the later merge is undone, on equal ranks the right one
            for undo_left in (True, False) if left > right else (False, True):
                token = left if undo_left else right
                if token in self.parts:
                    break
            else:
                return True
            if undo_left:
                bound, left = left, self.parts[left][1]
            else:
                bound, right = right + 1, self.parts[right][0]

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            ids = self._search(raw)
        if len(self) >= CACHED:
            self.clear()
        self[piece] = ids
        return ids

    def _search(self, raw: bytes) -> tuple[int, ...]:
        longest = [0] * len(raw)
        for end, (i, n) in self.trie.iter(raw.decode("latin-1")):
            longest[end - n + 1] = i  # ends ascend, so the longest is the last
        fits, lengths, shorter, size = self.fits, self.lengths, self.shorter, len(raw)
        out: list[int] = []
        dead = set()
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            good = end not in dead
            if good and out:
                key = out[-1] << 20 | token
                good = fits.get(key)
                if good is None:
                    if len(fits) >= CACHED:
                        fits.clear()
                    good = fits[key] = self._compatible(out[-1], token)
            if good:
                out.append(token)
                at = end
                if at == size:
                    return tuple(out)
                token = longest[at]
                continue
            while (smaller := shorter.get(token)) is None:  # nothing shorter here: this position leads nowhere
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
            token = smaller

    def pieces(self, text: str) -> list[str]:
        return (self.full if self.odd.search(text) else self.plain).findall(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.pieces(text))))


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The process's encoder of a rank file."""
    return Encoder(f"{folder}/{name}.tiktoken")


def encode(df: DataFrame, record: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(record, ids) of every row. Null and empty texts give an empty list. No shuffle; texts are taken whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        get, pieces = enc.__getitem__, enc.pieces
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for x in batch.column(1).to_pylist():
                if x:
                    flat.extend(chain.from_iterable(map(get, pieces(x))))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[record, "ids"])

    ship(df.sparkSession)
    kind = df.schema[record].dataType.simpleString()
    return spread(df.select(record, text)).mapInArrow(run, f"{record} {kind}, ids array<int>")
