"""Merkle manifest of a dataset: trees of three children by group, and a tree over the groups' tops.

H is the lower-case hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of a row's fields, each ``-`` if
null, else UTF-8 byte count, ``:``, value. Per group, leaves ascend by id; every three consecutive nodes (the last run may be shorter)
become their H while several remain. What remains is the group's subroot; subroots in the groups' order (null first, bytewise)
give the root likewise. A row's path holds, level by level up to the root, the run's other nodes before and after its own.

Lag/lead windows. Positions are gapless within a group, so the node of level l that begins at leaf p stands in the row of p (a first
child), its siblings ``3^l`` and ``2 * 3^l`` rows away. Per level, four fixed-offset ``lag``/``lead`` columns supply them, masked by the
node's slot (how many lie before it) and by the run's length (``lead`` finds no row beyond the last); the first child's row hashes
the parent. ``last(..., ignorenulls)`` hands the siblings down to all leaves below.

A window holds an aligned block of ``3^LEVELS`` rows of a group, never a whole group: all its levels use one exchange and one sort.
The blocks' tops are the leaves of the next tier, of 1/2187 of the rows, until a group has one node; the number of tiers is the
logarithm of the largest group. Paths of a tier are joined to the rows below by (group, block). A group's tops are small against it,
but of no fixed number; nothing is collected but the largest count.

Edge cases: rows of equal id are ordered by their leaf (equal rows are leaves of their own); a null id comes first in its group; a
null group is a group of its own; a single leaf is its group's subroot, a single subroot the root (empty path: ``proof`` is
H of nothing); an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litfeed.llm.common import positions, written

ARITY = 3
#: Levels of one window: blocks of 2,187 rows, below the 4,096 that Spark's window keeps without its sorter.
LEVELS = 7
SPAN = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """H of the values, each with its byte count (``-``: null)."""
    def told(v: Column) -> Column:
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(*map(told, values))


def _climbed(nodes: DataFrame) -> DataFrame:
    """``nodes(group, pos, n, digest, ...)`` with ``block``, ``path`` (siblings of each level within the block) and, in the block's
    first row, ``top``: the node that the block becomes."""
    none = F.lit("")
    w = Window.partitionBy("group", "block").orderBy("pos")
    down = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).withColumn("top", F.col("digest"))
    for level in range(LEVELS):
        step = ARITY ** level
        several, first = F.col("n") > step, F.col("pos") % step == 0
        slot = F.floor(F.col("pos") / step) % ARITY
        d = d.withColumns({"_b2": F.lag("top", 2 * step).over(w), "_b1": F.lag("top", step).over(w),
                           "_a1": F.lead("top", step).over(w), "_a2": F.lead("top", 2 * step).over(w)})
        before = F.when(slot == 1, F.col("_b1")).when(slot == 2, F.concat("_b2", "_b1")).otherwise(none)
        after = F.when(slot == 0, F.concat(F.coalesce("_a1", none), F.coalesce("_a2", none))).when(
            slot == 1, F.coalesce("_a1", none)).otherwise(none)
        both = F.when(several & first, F.struct(before.alias("before"), after.alias("after")))
        parent = F.when(first & (slot == 0), digest(F.col("top"), after))
        d = d.withColumns({f"_s{level}": both, "top": F.when(several, parent).otherwise(F.col("top"))}).withColumn(
            f"_s{level}", F.last(f"_s{level}", ignorenulls=True).over(down))
    own = [f"_s{level}" for level in range(LEVELS)]
    return d.withColumn("path", F.array_compact(F.array(*own))).drop("_b2", "_b1", "_a1", "_a2", *own)


def _paths(nodes: DataFrame, most: int, crown) -> DataFrame:
    """``nodes`` with ``path`` to the top, and what ``crown`` adds to the groups' last nodes (``path`` from there on, subroot, root).
    ``most``: the size of the largest group."""
    up = _climbed(nodes)
    heads = written(up.filter(F.col("pos") % SPAN == 0).select(
        "group", F.col("block").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("top").alias("digest")), "heads")
    above = _paths(heads, -(-most // SPAN), crown) if most > SPAN else crown(heads)
    above = above.select("group", F.col("pos").alias("block"), F.col("path").alias("_above"), "subroot", "root")
    return up.drop("top").join(above, ["group", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above", "block")


def _ended(heads: DataFrame) -> DataFrame:
    empty = F.array().cast("array<struct<before: string, after: string>>")
    return heads.select("group", "pos", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))


def _crowned(heads: DataFrame) -> DataFrame:
    """The tree over the groups' subroots."""
    tops = heads.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
    placed = written(positions(tops, "group", [F.col("of")], "pos", total="n"), "subroots")
    count = placed.count()
    if count == 0:
        return _ended(heads)
    up = _paths(placed, count, _ended)
    return up.select(F.col("of").alias("group"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")


def trees(leaves: DataFrame) -> DataFrame:
    """``leaves(group, id, leaf, ...)`` (``group``: any string or null) with ``path``, ``subroot`` and ``root``."""
    # a group's key that is never null and keeps the order
    keyed = leaves.withColumns({"group": F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("")), "digest": F.col("leaf")})
    keyed = written(keyed.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    placed = written(positions(keyed, "group", [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("_row")], "pos", total="n"), "placed")
    most = placed.agg(F.max("n")).first()[0] or 0
    return _paths(placed, most, _crowned).drop("_row", "digest", "pos", "n", "group")


def folded(of: Column, path: str = "path") -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, of, lambda node, s: digest(s["before"], node, s["after"]))


def proof(path: str = "path") -> Column:
    """H of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, ident: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, path, subroot, root): one row per document."""
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(ident).alias("id"),
                       leaf(*(F.col(f) for f in fields)).alias("leaf"))
    return trees(rows)


def checked(docs: DataFrame, changes: dict[str, Column], where: Column, ident: str = "doc_id", group: str = "source",
            fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest, and what it says of documents in which ``changes``
    (field -> new value) were made ``where`` this is true (null: false)."""
    new = leaf(*(changes.get(f, F.col(f)) for f in fields))
    old = leaf(*(F.col(f) for f in fields))
    rows = docs.select(F.col(group).cast("string").alias("group"), F.col(ident).alias("id"), old.alias("leaf"),
                       F.when(where, new).otherwise(old).alias("found"))
    t = trees(rows).withColumn("folded_root", folded(F.col("found")))
    return t.select("id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"))
