"""Language-model scoring by logistic context mixing over bits, and the unigram base.

Text: UTF-8 with A-Z in lower case, then an end symbol (byte 0xFF, which UTF-8 does not have); a byte is eight binary
decisions, most significant bit first. Predictors: for the last 1, 2, 3 and 5 bytes, the bit counts after that context and the
bits of the byte so far, kept for every context of the corpus under its own bytes (nothing is shared or dropped). Mixing: the
predictors' stretched probabilities (ln p/(1-p)) are weighted and summed; the weights are chosen by a gate (bit position and the
longest context that was seen) and learned online by gradient steps on coding cost, on counts without the occurrence that is
coded. Refinement: an adaptive map from (bits so far, mixed probability) to the frequency that was seen, averaged with the mixed
probability. The product over bits is a proper distribution over texts; ``score`` is its log10, ``bits_per_byte`` the cost.

Distribution. Documents are packed into chunks of about 4 MB, one row each, written once.
  1. Keys. A chunk sends its distinct (five bytes, next byte) with training counts to shards by the hash of the last three bytes of
     the context, so a shard has all that the two longer contexts of its keys need. The two shorter ones have 2^16 + 2^8
     contexts at most; their counts are summed by Spark and broadcast (2^24 numbers at most, a few hundred thousand in text).
  2. Shards sum the counts of equal keys, learn weights and refinement online (averaged by coded bits; fixed size), then
     code each distinct key of the corpus once. A chunk gets one number back for each of its keys, and adds them up by document.
  3. Words go the same way: distinct words with training counts to shards by hash, sums back.
The number of shards follows the corpus' bytes, so contexts and words may grow without bound. Sums and answers go through a tree: a task
joins the packets of one shard and ``FAN`` chunks, so a context or word that every chunk has puts no more on one task.
All documents whose crc32 is not divisible by ten train every part. Shards, sums and weights do not depend on how documents
were dealt to chunks, so reruns agree (up to the order in which a few thousand numbers are added).

Edge cases: null text is empty (the end symbol only); a null doc_id counts as the empty text for the crc32, so it is held
out; repeated rows are documents of their own; without training documents c, N and V are 0 and all bits cost one; other columns
do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import written

CHUNK = 4 << 20
#: Documents in a chunk at most: a number of 16 bits.
CHUNK_DOCS = 1 << 16
ORDERS = (1, 2, 3, 5)
#: Bytes of text that a shard stands for, and chunks whose packets for one shard meet in a task.
SHARD, FAN = 16 << 20, 256
#: Bits of the context that chooses the shard, and of the pairs of the orders that are broadcast.
LOCAL, COMMON = 24, 24
SMOOTH = 0.1
PRIOR = 0.4
CLIP = 8.0
GATES = 8 * (len(ORDERS) + 1)
INPUTS = len(ORDERS) + 1
BUCKETS = 33
#: Lanes of one gradient step, and the step sizes (first, decay, last).
BATCH, RATE, DECAY, LAST_RATE = 1 << 15, 0.3, 50, 0.02
PAD = 5

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FINAL = np.uint64(0xE7037ED1A0B428DB)


# -- chunks

def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, ids, held, sizes, blob): rows of about ``CHUNK`` bytes of lower-cased text, compressed."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0).alias("held"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress

        def row(ids, held, texts):
            return pa.RecordBatch.from_pylist([{"ids": ids, "held": held, "sizes": [len(t) for t in texts], "blob": pack(b"".join(texts))}],
                                              _CHUNK)

        ids, held, texts, size = [], [], [], 0
        for b in batches:
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(i)
                held.append(h)
                texts.append(t.as_py().translate(_LOWER))
                size += len(texts[-1])
                if size >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield row(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row(ids, held, texts)

    rows = given.mapInArrow(run, "ids array<long>, held array<boolean>, sizes array<long>, blob binary")
    return written(rows.select(F.monotonically_increasing_id().alias("chunk"), "*"), "chunks")


_CHUNK = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("blob", pa.binary())])


def _texts(row: dict) -> list[bytes]:
    import zstandard
    blob, ends = zstandard.ZstdDecompressor().decompress(row["blob"]), np.cumsum([0, *row["sizes"]]).tolist()
    return [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


# -- occurrences and bits

def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol (bytes and end) of the texts: the key (five bytes before it, itself), and the text's number."""
    frame = b"\xff" * PAD
    data = np.frombuffer(b"".join(x for t in texts for x in (frame, t, b"\xff")), np.uint8)
    sizes = np.fromiter((len(t) + PAD + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    real = np.ones(len(data), bool)
    real[(starts[:, None] + np.arange(PAD)).ravel()] = False
    key = np.zeros(max(0, len(data) - PAD), np.uint64)
    for j in range(PAD + 1):
        key <<= np.uint64(8)
        key |= data[j:len(data) - PAD + j]
    return key[real[PAD:]], np.repeat(np.arange(len(texts)), sizes - PAD)


def nodes(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each bit position, last first: (position, bits so far, bit) of the keys."""
    byte = (keys & np.uint64(255)).astype(np.int32)
    for pos in range(7, -1, -1):
        yield pos, (byte | 256) >> (8 - pos), ((byte >> (7 - pos)) & 1).astype(np.uint8)


def trained(texts: list[bytes], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a chunk in order, and how often they occur in training documents."""
    keys, of = occurrences(texts)
    packed = (keys << np.uint64(1)) | np.array(held, np.uint64)[of]
    del keys, of
    packed.sort()
    keys = packed >> np.uint64(1)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat((packed & np.uint64(1)) ^ np.uint64(1), starts).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, all second ones ...: packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one: (sorted keys, sums of ``n``)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(n[order], starts) if len(keys) else n


def along(keys: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Bit counts of sorted distinct keys (the last eight bits: the byte): row 8 has a key's own count, row b < 8 how often its
    context and first b bits were followed by the other bit."""
    ends, below = np.concatenate(([0], np.cumsum(total))), total
    counts = np.empty((9, len(keys)), np.float32)
    counts[8] = total
    for pos in range(7, -1, -1):
        prefix = keys >> np.uint64(8 - pos)
        new = np.concatenate(([True], prefix[1:] != prefix[:-1])) if len(keys) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        above = np.diff(ends[np.concatenate((starts, [len(keys)]))])[np.cumsum(new) - 1]
        counts[pos] = above - below
        below = above
    return counts


# -- packets: from chunks to shards and back

def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last three bytes of the context."""
    local = (keys >> np.uint64(8)) & np.uint64((1 << LOCAL) - 1)
    return (((local + np.uint64(1)) * _FINAL >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard, shard's bounds in it) of a chunk's sorted keys."""
    shard = shard_of(keys, shards)
    return np.argsort(shard, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards))))


def _words(texts: list[bytes], held: list[bool]) -> dict[bytes, int]:
    """The distinct words of a chunk with their training counts."""
    counts: Counter = Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            counts.update(t.split())
    for t, h in zip(texts, held, strict=True):
        if h:
            for w in t.split():
                counts.setdefault(w, 0)
    return counts


def dealt_words(words: dict[bytes, int], shards: int) -> dict[int, list[bytes]]:
    """shard -> its words of a chunk, in order."""
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w) % shards, []).append(w)
    return {s: sorted(out[s]) for s in sorted(out)}


def key_blob(keys: np.ndarray, n: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(_planes(np.diff(keys, prepend=np.uint64(0))) + _planes(n.astype(np.uint64)))


def keys_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    got = zstandard.ZstdDecompressor().decompress(blob)
    return np.cumsum(_numbers(got[:len(got) // 2], np.uint64), dtype=np.uint64), _numbers(got[len(got) // 2:], np.uint64).astype(np.int64)


def word_blob(words: list[bytes], n: list[int]) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words) + b"\n" + _planes(np.array(n, np.uint64)) + len(words).to_bytes(8, "big"))


def words_of(blob: bytes) -> tuple[list[bytes], list[int]]:
    import zstandard
    got = zstandard.ZstdDecompressor().decompress(blob)
    cut = len(got) - 8 - 8 * int.from_bytes(got[-8:], "big")
    return got[:cut - 1].split(b"\n"), _numbers(got[cut:-8], np.uint64).tolist()


def merged_keys(blobs: list[bytes]) -> bytes:
    found = [keys_of(b) for b in blobs]
    return key_blob(*summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])))


def merged_words(blobs: list[bytes]) -> bytes:
    sums: Counter = Counter()
    for b in blobs:
        for w, n in zip(*words_of(b), strict=True):
            sums[w] += n
    words = sorted(sums)
    return word_blob(words, [sums[w] for w in words])


MERGE = {"k": merged_keys, "w": merged_words}
PACKET = "kind string, shard long, chunk long, blob binary"


def packets(chunks: DataFrame, shards: int) -> DataFrame:
    """(kind, shard, chunk, blob) of keys (``k``) and words (``w``); written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            texts = _texts(r)
            keys, n = trained(texts, r["held"])
            order, bounds = dealt(keys, shards)
            keys, n = keys[order], n[order]
            out = [("k", s, key_blob(keys[bounds[s]:bounds[s + 1]], n[bounds[s]:bounds[s + 1]])) for s in np.flatnonzero(np.diff(bounds)).tolist()]
            del keys, n, order
            counts = _words(texts, r["held"])
            out += [("w", s, word_blob(words, [counts[w] for w in words])) for s, words in dealt_words(counts, shards).items()]
            for at in range(0, len(out), 512):
                kind, shard, blob = zip(*out[at:at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(shard, pa.int64()), pa.array([r["chunk"]] * len(kind), pa.int64()),
                                                  pa.array(blob, pa.binary())], ["kind", "shard", "chunk", "blob"])

    return written(chunks.mapInArrow(run, PACKET), "packets")


def gathered(sent: DataFrame, groups: int) -> DataFrame:
    """(kind, shard, blob): the sums of all packets, by a tree of ``FAN`` packets a task; ``groups``: of the chunks, at first."""
    def merge(rows: pa.Table) -> pa.Table:
        kind, shard, group = (rows.column(c)[0] for c in ("kind", "shard", "group"))
        blob = MERGE[kind.as_py()](rows.column("blob").to_pylist())
        return pa.table([pa.array([kind]), pa.array([shard]), pa.array([group]), pa.array([blob], pa.binary())],
                        names=["kind", "shard", "group", "blob"])

    d = sent.select("kind", "shard", F.col("group").cast("long").alias("group"), "blob")
    while True:
        d = d.groupBy("kind", "shard", "group").applyInArrow(merge, "kind string, shard long, group long, blob binary")
        if groups == 1:
            return written(d.drop("group"), "sums")
        groups = -(-groups // FAN)
        d = d.withColumn("group", F.col("group") % groups)


def common_pairs(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pair, training count) of the contexts of two bytes: 2^24 rows at most, summed by Spark, map-side first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            keys, n = keys_of(r["blob"])
            pair, total = summed(keys & np.uint64((1 << COMMON) - 1), n)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(total)], ["pair", "n"])

    rows = sums.filter("kind = 'k'").select("blob").mapInArrow(run, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")).toArrow().sort_by("pair")
    return rows.column("pair").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(np.int64)


# -- predictors

class Predictors:
    """The counts of a shard's keys (sorted, distinct) in all orders, ``without`` the occurrence that is coded, or with it.

    ``n``: training counts of the keys; ``pairs``: (pair, count) of the two shorter orders, of the whole corpus."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]):
        self.keys, counts, self.at, bits, start = keys, [], [], [], 0
        for o in ORDERS:
            mask = np.uint64((1 << 8 * (o + 1)) - 1)
            own, total = (summed(pairs[0] & mask, pairs[1]) if 8 * (o + 1) <= COMMON else summed(keys & mask, n))
            counts.append(along(own, total))
            self.at.append(np.searchsorted(own, keys & mask) + start)
            bits.append((own & np.uint64(255)).astype(np.int32))
            start += len(own)
        self.counts, byte = np.concatenate(counts, axis=1), np.concatenate(bits)
        self.bits = [((byte >> (7 - pos)) & 1).astype(bool) for pos in range(8)]
        self.made: tuple | None = None

    def _ready(self, without: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if self.made is None or self.made[0] != without:
            x, seen, same = [None] * 8, [None] * 8, self.counts[8]
            for pos in range(7, -1, -1):
                other, less = self.counts[pos], same - (same > 0) if without else same
                up = stretched(other, less)
                x[pos], seen[pos] = np.where(self.bits[pos], up, -up), less + other > 0
                same = same + other
            self.made = without, x, seen
        return self.made[1:]

    def inputs(self, places: np.ndarray, without: bool) -> Iterator[tuple]:
        """(bit position, bits so far, bit, stretched probabilities by order, whether the context was seen by order)."""
        x, seen = self._ready(without)
        at = [a[places] for a in self.at]
        for pos, node, bit in nodes(self.keys[places]):
            yield pos, node, bit, [x[pos][a] for a in at], [seen[pos][a] for a in at]


# -- mixing

def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.clip(np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))), -CLIP, CLIP)


def gates(pos: int, seen: list[np.ndarray]) -> np.ndarray:
    """Bit position and the longest context with any count."""
    top = np.zeros(len(seen[0]), np.int64)
    for k, s in enumerate(seen):
        top[s] = k + 1
    return top + pos * (len(ORDERS) + 1)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((x + CLIP) * ((BUCKETS - 1) / (2 * CLIP))), 0, BUCKETS - 1).astype(np.int64)


class Trainer:
    """One online pass: weights by gate, and the counts of the refinement map."""

    def __init__(self):
        self.steps, self.weights, self.seen = 0, first_weights(), np.zeros(GATES)
        self.refined = np.zeros((256 * BUCKETS, 2))

    def learn(self, model: Predictors, counts: np.ndarray) -> None:
        # mixed order, else neighbouring contexts make up a step
        places = np.flatnonzero(counts)
        places = places[np.random.default_rng(len(places)).permutation(len(places))]
        for at in range(0, len(places), BATCH):
            part = places[at:at + BATCH]
            n = counts[part].astype(np.float64)
            rate = max(LAST_RATE, RATE / (1 + self.steps / DECAY))
            # without the occurrence that is coded
            for pos, node, bit, inputs, seen in model.inputs(part, True):
                gate = gates(pos, seen)
                x = np.stack([*inputs, np.full(len(part), 0.3, np.float32)], axis=1)
                mixed = np.einsum("ij,ij->i", x, self.weights[gate])
                error = (bit - squash(mixed)) * n
                total = np.bincount(gate, n, GATES)
                step = np.stack([np.bincount(gate, error * x[:, k], GATES) for k in range(INPUTS)], axis=1)
                # a gate that is seldom seen takes small steps
                self.weights += rate * step / np.maximum(total, 0.05 * n.sum())[:, None]
                self.seen += total
                cell = (node * BUCKETS + bucket(mixed)) * 2 + bit
                self.refined += np.bincount(cell, n, 512 * BUCKETS).reshape(-1, 2)
            self.steps += 1


def first_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 1.2 / len(ORDERS))
    weights[:, -1] = 0
    return weights


def mixing(sums: DataFrame, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(weights by gate, refinement map) from the shards' sums: averages over shards, weighted by what each has coded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            trainer, (keys, n) = Trainer(), keys_of(r["blob"])
            trainer.learn(Predictors(keys, n, pairs.value), n)
            w, seen, cells = trainer.weights, trainer.seen, trainer.refined
            out = [("w", g * INPUTS + k, w[g, k] * seen[g], seen[g]) for g in range(GATES) for k in range(INPUTS) if seen[g]]
            out += [("r", int(i), cells[i, 1], cells[i].sum()) for i in np.flatnonzero(cells.sum(axis=1))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["kind", "slot", "value", "mass"])

    total = sums.filter("kind = 'k'").select("blob").mapInArrow(run, "kind string, slot long, value double, mass double").groupBy(
        "kind", "slot").agg(F.sum("value").alias("value"), F.sum("mass").alias("mass"))
    weights = first_weights()
    centres = np.linspace(-CLIP, CLIP, BUCKETS)
    refined = np.tile(squash(centres), (256, 1))
    for r in total.collect():  # of fixed size: gates x inputs and map cells
        if r["kind"] == "w":
            weights[divmod(r["slot"], INPUTS)] = r["value"] / r["mass"]
        else:
            node, b = divmod(r["slot"], BUCKETS)
            refined[node, b] = (r["value"] + 4 * refined[node, b]) / (r["mass"] + 4)
    return weights.astype(np.float32), refined.astype(np.float32)


def coded(model: Predictors, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """The log2 probability of each key's byte after its context."""
    out = np.zeros(len(model.keys))
    for at in range(0, len(out), BATCH):
        part = np.arange(at, min(at + BATCH, len(out)))
        for pos, node, bit, inputs, seen in model.inputs(part, False):
            gate = gates(pos, seen)
            mixed = weights[:, -1][gate] * np.float32(0.3)
            for k, x in enumerate(inputs):
                mixed += weights[:, k][gate] * x
            p = 0.5 * (squash(np.clip(mixed, -CLIP, CLIP)) + refined[node, bucket(mixed)])
            p = np.clip(p, 1e-5, 1 - 1e-5)
            out[part] += np.log2(np.where(bit, p, 1 - p))
    return out


# -- scores

def answered(sent: DataFrame, sums: DataFrame, groups: int, pairs, model) -> DataFrame:
    """(chunk, kind, shard, blob): for each packet, in its order, the log2 probability of its keys (32 bits) or the counts of its words."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        for r in _rows(batches):
            blob = r["blob"]
            if r["kind"] == "k":
                keys, n = keys_of(blob)
                logs = coded(Predictors(keys, n, pairs.value), *model.value).astype(np.float32)
                blob = pack(_planes(np.diff(keys, prepend=np.uint64(0))) + _planes(logs))
            yield pa.RecordBatch.from_arrays([pa.array([r["kind"]]), pa.array([r["shard"]], pa.int64()), pa.array([blob], pa.binary())],
                                             ["kind", "shard", "blob"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        if not len(left):  # no chunk of the group has a key of the shard
            return _ANSWER.empty_table()
        kind, whole = left.column("kind")[0].as_py(), right.column("blob")[0].as_py()
        if kind == "k":
            got = unpack(whole)
            cut = len(got) // 12 * 8
            keys, logs = np.cumsum(_numbers(got[:cut], np.uint64), dtype=np.uint64), _numbers(got[cut:], np.float32)
            blobs = [pack(_planes(logs[np.searchsorted(keys, keys_of(b.as_py())[0])])) for b in left.column("blob")]
        else:
            count = dict(zip(*words_of(whole), strict=True))
            blobs = [pack(_planes(np.array([count[w] for w in words_of(b.as_py())[0]], np.uint64))) for b in left.column("blob")]
        return pa.table([left.column("chunk"), left.column("kind"), left.column("shard"), pa.array(blobs, pa.binary())], schema=_ANSWER)

    whole = written(sums.mapInArrow(code, "kind string, shard long, blob binary"), "coded")
    whole = whole.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    by = ("kind", "shard", "group")
    return sent.groupBy(*by).cogroup(whole.groupBy(*by)).applyInArrow(answer, "chunk long, kind string, shard long, blob binary")


_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("shard", pa.int64()), ("blob", pa.binary())])


def learned(chunks: DataFrame):
    """All that the corpus gives: (packets, sums, groups, pairs, model, shards, training documents, tokens, distinct tokens)."""
    spark = chunks.sparkSession
    n_chunks, size, docs = chunks.agg(
        F.count("*"), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)),
        F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()
    shards, groups = max(1, -(-size // SHARD)), max(1, -(-n_chunks // FAN))
    sent = packets(chunks, shards).withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    sums = gathered(sent, groups)
    pairs = spark.sparkContext.broadcast(common_pairs(sums))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n = words_of(r["blob"])[1]
            yield pa.RecordBatch.from_pydict({"v": [sum(x > 0 for x in n)], "n": [sum(n)]})

    v, n = sums.filter("kind = 'w'").select("blob").mapInArrow(known, "v long, n long").agg(
        F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = spark.sparkContext.broadcast(mixing(sums, pairs))
    return sent, sums, groups, pairs, model, shards, docs, n + docs, v + (docs > 0)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per document."""
    chunks = chunked(docs)
    sent, sums, groups, pairs, model, shards, train_docs, n_train, distinct = learned(chunks)
    below = math.log10(n_train + SMOOTH * (distinct + 1)) if n_train else math.log10(SMOOTH)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard
        unpack, found = zstandard.ZstdDecompressor().decompress, []
        back = {k: sorted((s, b) for kk, s, b in zip(right.column("kind").to_pylist(), right.column("shard").to_pylist(),
                                                     right.column("blob").to_pylist(), strict=True) if kk == k) for k in "kw"}
        for r in left.to_pylist():
            texts, c = _texts(r), {}
            for (_, words), (_, b) in zip(dealt_words(_words(texts, r["held"]), shards).items(), back["w"], strict=True):
                c.update(zip(words, _numbers(unpack(b), np.uint64).tolist(), strict=True))
            index = {w: i for i, w in enumerate(c)}
            counts = np.fromiter(c.values(), np.float64, len(c))
            cost, end = np.log10(counts + SMOOTH) - below, math.log10(train_docs + SMOOTH) - below
            keys, of = occurrences(texts)
            # key and text's number in one word: sorted in place, equal keys side by side
            packed = (keys << np.uint64(16)) | of.astype(np.uint64)
            del keys, of
            packed.sort()
            of = (packed & np.uint64(0xFFFF)).astype(np.int32)
            packed >>= np.uint64(16)
            new = np.concatenate(([True], packed[1:] != packed[:-1]))
            order, _ = dealt(packed[new], shards)
            logs = np.empty(len(order), np.float32)
            logs[order] = np.concatenate([_numbers(unpack(b), np.float32) for _, b in back["k"]])
            bits = np.bincount(of, logs[np.cumsum(new, dtype=np.int32) - 1], len(texts))
            del packed, of, new, logs
            for i, (doc, held, text) in enumerate(zip(r["ids"], r["held"], texts, strict=True)):
                places = np.fromiter(map(index.__getitem__, text.split()), np.int64)
                found.append((doc, held, len(places) + 1, int((counts[places] > 0).sum()) + (train_docs > 0), n_train,
                              float(cost[places].sum()) + end, float(bits[i]) * math.log10(2), -float(bits[i]) / max(1, len(text))))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _SCORED, strict=True)], schema=_SCORED)

    answers = answered(sent, sums, groups, pairs, model)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
             "bits_per_byte double")


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                     ("bits_per_byte", pa.float64())])
