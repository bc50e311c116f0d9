"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: words of the lower-cased text (A-Z only), 3-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1
if set in over half of the hashes. Two fingerprints link at 2 or fewer differing bits; a component is what links connect.

Search. Only distinct fingerprints are compared, so copies cost nothing. The 64 bits are cut into eight blocks; two
fingerprints that differ in at most 2 bits agree in at least six blocks, so each fingerprint goes to 28 tables, one for
each pair of blocks left out, keyed by the other 48 bits. A bucket then varies in 16 bits, so it holds at most 65,536
distinct fingerprints at any input size (most hold one): no hot key is possible, and none needs a cap.

Comparison. A bucket is stored vertically, one bit plane per varying bit, in blocks of 2,048 lanes. A query's planes are
XORed in one at a time and added to a carry-save counter of two bits per lane; a lane that reaches 3 is dead, and a block is
abandoned as soon as all of its open lanes are dead. A bucket emits a spanning forest of its links (fewer rows than it
has fingerprints), never all pairs.

Edge cases: null text, like a text without words, has fingerprint zero and links like any other; a short text is one shingle;
a null doc_id keeps its fingerprint and belongs to its component, whose id is the smallest id that is not null (null if
none); repeated rows stay; other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litfeed.llm.common import fresh, written
from litfeed.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 8
LANES = 2048
#: Shingles hashed at once.
STEP = 65536

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SLOT = np.arange(8, dtype=np.int64) * 256
#: The 48 bits that a table keeps, for each pair of blocks left out.
MASKS = [((1 << 64) - 1) ^ sum(0xFF << (8 * k) for k in out) for out in combinations(range(BLOCKS), RADIUS)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as an unsigned integer."""
    from xxhash import xxh64_intdigest
    words = text.translate(_LOWER).split()  # ASCII white space: 20, 09 to 0D
    if not words:
        return 0
    joined, count = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1:]
    totals = np.zeros((8, 8), np.int64)
    for at in range(0, count, STEP):
        spans = zip(starts[at:min(at + STEP, count)].tolist(), last[at:at + STEP].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        # how often each value of each of the eight bytes occurs, then the bits of these values
        values = hashes.view(np.uint8).reshape(-1, 8) + _SLOT
        totals += np.bincount(values.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * totals.ravel() > count).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", keep: list[str] | None = None,
                     shingle: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` (default: all) of ``docs`` and the fingerprint as a (signed) long."""
    keep = docs.columns if keep is None else keep
    where = fresh(docs, "_text")
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias(where))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), shingle) for x in b.column(b.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints.view(np.int64))], [*keep, name])

    return given.mapInArrow(run, schema)


def forest(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(place of a root, place of a member) for the components of distinct fingerprints, bit-sliced.

    The counter has two bits a lane, so the radius is 2 at most.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the carry-save counter holds a radius of 0 to 2")
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = bits.sum(axis=0, dtype=np.int64)
    columns = np.flatnonzero((total > 0) & (total < len(prints)))
    rows = bits[:, columns].astype(bool)
    blocks = []
    for at in range(0, len(prints), LANES):
        part = np.packbits(bits[at:at + LANES][:, columns], axis=0, bitorder="little")
        planes = [int.from_bytes(part[:, c].tobytes(), "little") for c in range(len(columns))]
        blocks.append([planes, (1 << min(LANES, len(prints) - at)) - 1, (1 << min(LANES, len(prints) - at)) - 1])
    found = []
    for root in range(len(prints)):
        k, lane = divmod(root, LANES)
        if not blocks[k][2] >> lane & 1:
            continue
        blocks[k][2] ^= 1 << lane
        queue = [root]
        while queue:
            query = rows[queue.pop()].tolist()
            for k, block in enumerate(blocks):
                planes, full, unseen = block
                if not unseen:
                    continue
                ones = twos = dead = 0
                for plane, bit in zip(planes, query, strict=True):
                    differs = plane ^ full if bit else plane
                    carry = ones & differs
                    ones ^= differs
                    twos |= carry  # a lane that wraps is dead already
                    dead |= ones & twos if radius == 2 else twos if radius == 1 else ones
                    if not unseen & ~dead:
                        break
                hits = unseen & ~dead
                block[2] ^= hits
                while hits:
                    low = hits & -hits
                    member = k * LANES + low.bit_length() - 1
                    found.append((root, member))
                    queue.append(member)
                    hits ^= low
    return found


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the buckets in batches that are sorted by table and key; a bucket may span batches."""
    masks = np.array(MASKS, np.uint64)
    table, prints = np.empty(0, np.int32), np.empty(0, np.uint64)

    def links(table, prints, ends):
        for a, b in ends:
            for x, y in forest(prints[a:b]):
                yield prints[a + x], prints[a + y]

    def batch(pairs):
        got = np.array(list(pairs), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    for b in batches:
        table = np.concatenate((table, b.column(0).to_numpy()))
        prints = np.concatenate((prints, b.column(1).to_numpy().view(np.uint64)))
        key = prints & masks[table]
        starts = np.flatnonzero(np.concatenate(([True], (table[1:] != table[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(starts)  # the last bucket may go on
        big = np.flatnonzero(sizes > 1)
        yield batch(links(table, prints, [(starts[i], starts[i + 1]) for i in big]))
        table, prints = table[starts[-1]:], prints[starts[-1]:]
    if len(prints) > 1:
        yield batch(links(table, prints, [(0, len(prints))]))


def linked(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect the components of ``prints(fp)``, distinct fingerprints."""
    kept = F.col("fp").bitwiseAND(F.get(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in MASKS]), F.col("t")))
    tables = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(MASKS) - 1))).alias("t")).select("t", "fp")
    dealt = tables.repartition("t", kept).sortWithinPartitions("t", kept, "fp")
    return dealt.mapInArrow(_bucket_links, "a long, b long")


def roots(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of the written table ``prints(fp, doc_id)``."""
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    stars = written(components(linked(reps.select("fp"))), "components")
    known = reps.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    prints = written(with_fingerprint(docs, "fp", keep=["doc_id"]), "prints")
    out = prints.join(roots(prints), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns: the smallest doc_id (nulls last), then the first row."""
    row, fp = fresh(docs, "_row"), fresh(docs, "_fp")
    wide = written(with_fingerprint(docs.withColumn(row, F.monotonically_increasing_id()), fp), "docs")
    narrow = wide.select(F.col(row).alias("row"), "doc_id", F.col(fp).alias("fp"))
    best = narrow.join(roots(narrow), "fp").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("best"))
    return wide.join(best.select(F.col("best.row").alias(row)), row, "left_semi").drop(row, fp)
