"""Byte-pair encoding of whole texts with a public rank file.

Method: contiguous rank array.  For a short word the boundaries of its parts and the ranks of adjacent pairs lie in two
flat lists; the smallest rank is looked up again and again, its boundary deleted and the two neighbouring ranks
refreshed.  Long words (runs of blanks, encoded data) take the same merges from a heap, as rescanning would be quadratic.

Every partition keeps the words that it has met, so a word is merged about once in a task.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rank file of the 50k byte vocabulary; a parameter of every operator.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space as the public vocabulary's split pattern knows it.
BLANKS = r" \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def ranges(first_letter: str, stop: int) -> str:
    """Code points below ``stop`` whose general category begins with ``first_letter``, as ranges of a character class."""
    out, start = [], None
    for code in range(stop + 1):
        inside = code < stop and unicodedata.category(chr(code))[0] == first_letter
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def splitter(stop: int) -> re.Pattern[str]:
    """How the public vocabulary splits a text before merging, for texts of code points below ``stop``.

    Written with classes of the standard library, whose tables are several times as fast as property lookups.
    """
    letter, number = ranges("L", stop), ranges("N", stop)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{BLANKS}{letter}{number}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


ASTRAL = re.compile("[\U00010000-\U0010ffff]").search
SHORT = 256
KNOWN_WORDS = 400_000
NONE = 1 << 60


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``word`` by the contiguous rank array."""
    bounds = list(range(len(word) + 1))
    adjacent = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        at = adjacent.index(least)
        del adjacent[at], bounds[at + 1]
        if at < len(adjacent):
            adjacent[at] = ranks.get(word[bounds[at] : bounds[at + 2]], NONE)
        if at:
            adjacent[at - 1] = ranks.get(word[bounds[at - 1] : bounds[at + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of ``word``, the same merges in the same order, from a heap over a linked list of parts."""
    size = len(word)
    end = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * size
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        if not alive[left] or right >= size or end[right] != stop:
            continue
        end[left], alive[right] = stop, 0
        if stop < size:
            before[stop] = left
            if (r := ranks.get(word[left : end[stop]], NONE)) != NONE:
                heapq.heappush(heap, (r, left, end[stop]))
        if left and (r := ranks.get(word[before[left] : stop], NONE)) != NONE:
            heapq.heappush(heap, (r, before[left], stop))
    ids, at = [], 0
    while at < size:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


class Words(dict):
    """Word -> ids, filled as words are met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        ids = (self.ranks[raw],) if raw in self.ranks else tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks))
        if len(raw) <= SHORT:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.words = Words(ranks)

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        stop = 0x80 if text.isascii() else 0x110000 if ASTRAL(text) else 0x10000
        return map(self.words.__getitem__, splitter(stop).findall(text))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none."""
        return list(chain.from_iterable(self.parts(text))) if text else []

    def size(self, text: str | None) -> int:
        return sum(map(len, self.parts(text))) if text else 0


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each rank file in a Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = BYTE_BPE_50K) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row; null and empty texts give an empty list.

    One narrow pass: the scan reads two columns, no shuffle, Arrow in and out.  Repeated rows come out repeated; the strings
    of special tokens are ordinary text; columns besides the two are not read, so their names cannot clash.
    """
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(chain.from_iterable(enc.parts(text)))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_col, text_col).mapInArrow(run, schema)


def text_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = BYTE_BPE_50K) -> DataFrame:
    """``id_col`` and ``n_tokens`` (int) of every row; 0 for a null or empty text."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = encoder(ranks).size
        for batch in batches:
            sizes = array("i", map(size, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(memoryview(sizes), pa.int32())], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.IntegerType())])
    return df.select(id_col, text_col).mapInArrow(run, schema)
