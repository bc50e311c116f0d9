"""K-d tree sharding (native: DataFrame functions only).

The rows are points in metadata space. A node that holds k shards sends floor(k/2)/k of its bytes left, cut at the
weighted median (weight: bytes) along its widest dimension, until each leaf is one shard of the target bytes. Medians
are found without moving a row: per node a histogram of at most 4,096 bins over the key range, summed map-side, from
which the bin with the target is narrowed until it holds one unit. Only histograms are shuffled; per level and pass
the driver gets one row per node (at most one per shard).

Dimensions: size (bytes), language, and the text's CRC. Each sort key holds size or language and the CRC, so equal
texts are one unit and stay together; a unit is cut (in row order) only where keeping it whole would put a node off
its target by more than ``TOLERANCE`` of a leaf, as for a group of copies that holds a third of all rows.

Law ``bytes``: the shards' sizes are near equal, to within about one document a level.
Edge cases: null text has no bytes (size 8); null language sorts first; null or repeated doc_ids are told apart by
the row; an empty table gives an empty result; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litfeed.llm.common import written

BIN_BITS = 12
#: Share of a leaf's target bytes by which a whole unit may move a cut.
TOLERANCE = 0.01
ROW_BYTES = 8
DIMS = ("k_size", "k_lang", "k_crc")


@dataclass
class Node:
    """A node of the tree, named by its first shard. Rows with a key under ``edge`` along ``dim`` go left, and those
    at ``edge`` with a row id under ``row_edge``."""
    first: int
    shards: int
    size: int
    target: int = 0
    dim: int = 0
    edge: int = 0
    row_edge: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        """The leaf (so far) of a row: one comparison for each split."""
        if self.left is None:
            return F.lit(self.first)
        key = F.col(DIMS[self.dim])
        goes_left = (key < self.edge) | ((key == self.edge) & (F.col("row") < self.row_edge))
        return F.when(goes_left, self.left.column()).otherwise(self.right.column())


def points(docs: DataFrame) -> DataFrame:
    """One narrow row per document, written once: row, doc_id, size, text_crc32, and a non-negative key per dimension."""
    text, cap = F.coalesce(F.col("text"), F.lit("")), F.lit((1 << 31) - 1)
    tag = F.col("lang") if "lang" in docs.columns else F.lit("")
    d = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        # the first three bytes of the language tag as a number
        F.conv(F.rpad(F.substring(F.hex(F.encode(F.coalesce(tag, F.lit("")), "UTF-8")), 1, 6), 6, "0"), 16, 10)
        .cast("long").alias("lang_code"))
    short, crc = F.least(F.col("size"), cap), F.col("text_crc32")
    return written(d.select(
        "row", "doc_id", "size", "text_crc32", (short * F.lit(1 << 32) + crc).alias("k_size"),
        (F.col("lang_code") * F.lit(1 << 32) + crc).alias("k_lang"),
        (crc * F.lit(1 << 31) + short).alias("k_crc")), "points")


def _of(values: dict, shards: int) -> Column:
    """A long per node (null for other nodes), looked up by the node column."""
    return F.get(F.array(*[F.lit(values.get(i)).cast("long") for i in range(shards)]), F.col("node"))


def _locate(rows: DataFrame, nodes: list[Node], shards: int, key: Column, spans: dict, before: dict) -> dict:
    """Per node the key value that holds its target byte, the bytes before that value, and the value's bytes.

    spans: first and last key by node; before: bytes that lie before the first.
    """
    found, spans, before = {}, dict(spans), dict(before)
    target = {n.first: n.target for n in nodes}
    while spans:
        low, width = {}, {}
        for n, (lo, hi) in spans.items():
            low[n], width[n] = lo, 1 << max(0, (hi - lo).bit_length() - BIN_BITS)
        lo, hi = _of(low, shards), _of({n: s[1] for n, s in spans.items()}, shards)
        bins = F.call_function("div", key - lo, _of(width, shards))
        hist = rows.filter(key.between(lo, hi)).select("node", bins.alias("bin"), "size").groupBy("node", "bin").agg(
            F.sum("size").alias("bytes"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("prior", F.coalesce(F.sum("bytes").over(run), F.lit(0)))
        want = _of({n: target[n] - before[n] for n in spans}, shards)
        for r in hist.filter((F.col("prior") <= want) & (F.col("prior") + F.col("bytes") > want)).collect():
            n = r["node"]
            first = low[n] + r["bin"] * width[n]
            last = min(spans[n][1], first + width[n] - 1)
            before[n] += r["prior"]
            if first == last:
                found[n] = (first, before[n], r["bytes"])
                del spans[n]
            else:
                spans[n] = (first, last)
    return found


def _ends(rows: DataFrame, keys) -> dict:
    aggs = [f(c).alias(f"{f.__name__}_{c}") for c in keys for f in (F.min, F.max)]
    return {r["node"]: r for r in rows.groupBy("node").agg(*aggs).collect()}


def _cut(rows: DataFrame, whole, nodes: list[Node], shards: int, tolerance: float) -> dict:
    """Sets dim, edge and row_edge of each node; the bytes that go left by node."""
    ends, taken, inner = _ends(rows, DIMS), {}, {}
    for n in nodes:
        share = [(ends[n.first][f"max_{c}"] - ends[n.first][f"min_{c}"])
                 / max(1, whole[f"max_{c}"] - whole[f"min_{c}"]) for c in DIMS]
        n.dim = share.index(max(share))  # the first of equals
    key = F.get(F.array(*DIMS), _of({n.first: n.dim for n in nodes}, shards).cast("int"))
    span = lambda n, c: (ends[n.first][f"min_{c}"], ends[n.first][f"max_{c}"])
    unit = _locate(rows, nodes, shards, key, {n.first: span(n, DIMS[n.dim]) for n in nodes}, {n.first: 0 for n in nodes})
    for n in nodes:  # at the nearer end of the unit that holds the target
        n.edge, before, size = unit[n.first]
        up = 2 * (n.target - before) > size
        taken[n.first] = before + size * up
        if abs(taken[n.first] - n.target) > tolerance:
            inner[n.first] = (n.edge, before)
        else:
            n.edge += up
    if inner:  # inside of the unit
        open_nodes = [n for n in nodes if n.first in inner]
        tied = rows.filter(key == _of({k: v[0] for k, v in inner.items()}, shards))
        ends = _ends(tied, ["row"])
        at = _locate(tied, open_nodes, shards, F.col("row"), {n.first: span(n, "row") for n in open_nodes},
                     {k: v[1] for k, v in inner.items()})
        for n in open_nodes:
            n.row_edge, before, size = at[n.first]
            up = 2 * (n.target - before) > size
            taken[n.first] = before + size * up
            n.row_edge += up
    return taken


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, row, shard) of every document."""
    rows = points(docs)
    whole = rows.agg(F.sum("size").alias("size"), *[f(c).alias(f"{f.__name__}_{c}") for c in DIMS for f in (F.min, F.max)]
                     ).first()
    root = Node(0, shards, whole["size"] or 0)
    todo = [root]
    while todo := [n for n in todo if n.shards > 1 and n.size > 0]:
        for n in todo:
            n.target = n.size * (n.shards // 2) // n.shards
        live = rows.withColumn("node", root.column()).filter(F.col("node").isin([n.first for n in todo]))
        taken = _cut(live, whole, todo, shards, TOLERANCE * root.size / shards)
        for n in todo:
            half, size = n.shards // 2, taken[n.first]
            n.left, n.right = Node(n.first, half, size), Node(n.first + half, n.shards - half, n.size - size)
        todo = [c for n in todo for c in (n.left, n.right)]
    return rows.select("doc_id", "size", "text_crc32", "row", root.column().cast("int").alias("shard"))


def slotted(assigned: DataFrame) -> DataFrame:
    """Gapless ``slot`` from 0 within each shard, in row order. A row id starts with the number of the input
    partition (33 low bits count within it), so rows are numbered within (shard, input partition), and only the
    counts of these pieces meet per shard."""
    d = assigned.withColumn("piece", F.shiftright("row", 33))
    run = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = d.groupBy("shard", "piece").count().select(
        "shard", "piece", F.coalesce(F.sum("count").over(run), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("row")) - 1
    return d.withColumn("within", within).join(pieces, ["shard", "piece"]).withColumn(
        "slot", (F.col("before") + F.col("within")).cast("long")).drop("within", "before", "piece")
