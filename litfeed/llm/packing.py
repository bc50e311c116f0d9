"""Best-fit-decreasing packing of documents into fixed windows.

A document is its token ids and an end id. Documents longer than a window are first cut into full windows; the rest of a
document is one piece. Pieces are dealt into groups by a hash of their document, about ``GROUP`` to each, and packed longest
first: a segment tree indexed by remaining capacity finds the open window that a piece leaves with the least room; if none
has room, a window is opened. Pieces travel without their ids, so a group is bounded by its number of pieces and a hot source
or long documents put no weight on one task.

Tokens: byte-level BPE from a vocabulary file of the tokenizers library. Texts go to the faster of two encoders of that
vocabulary; those with the text of a special token, which only the tokenizer itself knows, and those with a run of ``LONG_RUN``
white-space characters, on which the other one's pattern runs out of stack, go to the tokenizer. The ids are the same.

Sequence ids are unique, not gapless: even for full windows, odd for packed ones.

Edge cases: null text is empty (its one piece is the end id); equal or null doc_ids are told apart by the row; other
columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litfeed.llm.common import fresh, written

WINDOW = 1024
END = 0
#: Pieces in one packing group, on average.
GROUP = 100_000
#: White space in one run that the faster encoder is not given any more (its time grows with the square, and above 600,000 it fails).
LONG_RUN = 1000
#: How byte-level vocabularies write a byte as a character (printable ones as they are, the others from 256 on).
_PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_BYTE_OF = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # an id of this vocabulary is the rank of its merge
        ranks = {bytes(_BYTE_OF[c] for c in k): v for k, v in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if k not in self.special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or (len(text) >= LONG_RUN and self.long_run.search(text)):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(row, doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every document of ``docs(row, doc_id, text)``."""
    given = docs.select("row", "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = T.StructType([*given.schema.fields[:2], *T._parse_datatype_string(PIECES).fields])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            of, out, ids = [], [], []
            for i, text in enumerate(b.column(2)):
                raw = enc.encode(text.as_py()) + end
                n = len(raw) // 4
                for start in range(0, n, window):
                    part = raw[4 * start:4 * (start + window)]
                    of.append(i)
                    out.append((start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = np.array(out, np.int64).reshape(-1, 4)
            arrays = [b.column(0).take(pa.array(of, pa.int64())), b.column(1).take(pa.array(of, pa.int64())),
                      *(pa.array(cols[:, k]) for k in range(4))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, schema.names)

    return given.mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities 0 to ``window``: the windows open at each capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)  # windows in the subtree
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, number: int) -> None:
        self.at[capacity].append(number)
        i = self.leaves + capacity
        while i:
            self.open[i] += 1
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` with an open window, or -1."""
        i = self.leaves + need
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return -1
            i += 1
            while i < self.leaves:
                i *= 2
                i += not self.open[i]
        return i - self.leaves

    def take(self, capacity: int) -> int:
        i = self.leaves + capacity
        while i:
            self.open[i] -= 1
            i >>= 1
        return self.at[capacity].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) for each length; the lengths come longest first."""
    tree, found, opened = Capacities(window), [], 0
    for n in lengths:
        capacity = tree.tightest(n)
        if capacity < 0:
            capacity, number = window, opened
            opened += 1
        else:
            number = tree.take(capacity)
        found.append((number, window - capacity))
        if capacity > n:
            tree.add(capacity - n, number)
    return found


def placed(rests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, sequence_id, offset) for ``rests(row, length)``, pieces shorter than a window."""
    groups = max(1, -(-rests.count() // GROUP))
    dealt = rests.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    # a group is whole in one partition, longest pieces first; ties by row, so a repeated task packs alike
    dealt = dealt.repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows, lengths, group):
            at = np.array(best_fit(lengths.tolist(), window), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(at[:, 0] + (group << 32)), pa.array(at[:, 1])],
                                              ["row", "sequence_id", "offset"])

        held = np.empty((0, 3), np.int64)
        for b in batches:
            held = np.concatenate((held, np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)))
            ends = np.flatnonzero(np.diff(held[:, 2])) + 1
            for part in np.split(held, ends)[:-1]:
                yield packed(part[:, 0], part[:, 1], int(part[0, 2]))
            held = held[ends[-1] if len(ends) else 0:]
        if len(held):
            yield packed(held[:, 0], held[:, 1], int(held[0, 2]))

    return dealt.mapInArrow(run, "row long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    row = fresh(docs, "_row")
    given = docs.withColumn(row, F.monotonically_increasing_id()).select(F.col(row).alias("row"), "doc_id", "text")
    cut = written(pieces(given, vocabulary, window, with_ids), "pieces")
    full = F.col("length") == window
    columns = [c for c in cut.columns if c != "row"]
    whole = cut.filter(full).select(*columns, (F.monotonically_increasing_id() * 2).alias("sequence_id"),
                                    F.lit(0).cast("long").alias("offset"))
    at = placed(cut.filter(~full).select("row", "length"), window)
    rest = cut.filter(~full).join(at, "row").select(*columns, (F.col("sequence_id") * 2 + 1).alias("sequence_id"), "offset")
    return whole.unionByName(rest)
