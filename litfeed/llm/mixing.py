"""Mixing sources to target weights: water-filled targets, then pivotal dependent rounding of copies.

Size: a document's words (runs without ASCII white space; null: 0). Sources in code-point order, null last, weigh 1, 2, 3, repeating,
and share all words by weight; a source's target stops at ``MOST`` times its words, and the excess is shared again by weight among
the others until none is above. So every document of a source should be taken ``r = target / words of the source`` times: ``floor(r)``
copies, and one more with probability ``r - floor(r)``, the fraction.

Pivotal rounding. Two documents with fractional copies meet, and words (size times fraction) move from one to the other until one
has no copy or a whole one; the direction is drawn so that both expectations stay. The sum of words does not change, so the
source's taken words miss its target only by the rounding of the very last document, never by the sum of independent draws.

A source's documents are numbered from the longest to the shortest. Each of its ``HEAD`` longest meets all that follow it as one
partner, of one common fraction: it becomes whole or nothing, and the fraction of all others moves the other way. So no
document left over can be longer than a hundredth of its source's words. A document so long that all others together cannot make
up for one of the two outcomes gets the other one without a draw (then its expectation is not kept, but the target is).

Reduction tree. Of the others, each ``FAN`` consecutive ones are one node, which pairs them until one is left; these are
the rows of the next level, until a source has one node, whose last document is rounded by a draw. A task holds one node at a
time, of at most ``FAN`` rows of three numbers, however large the source; levels are logarithmic; each is a written table. Draws
follow from source, level and node, and numbers from sizes and ids, so reruns agree (whatever the partitions).

The targets need the number of sources times a few numbers: rounds of one aggregate each, joined back by Spark (which broadcasts them
only if their written size allows it).

Edge cases: null or blank texts have size 0 and take nothing; a source without words has target 0; rows of equal id are documents of
their own (equal rows may differ in their copies, as a whole reruns agree); an empty table gives an empty result; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import fresh, positions, words, written

#: No source is taken more often than this, on average and for each document.
MOST = 3
#: Weights of the sources, in order, repeating.
WEIGHTS = (1, 2, 3)
#: Rows that a node of the tree rounds.
FAN = 1024
#: The longest documents of a source, rounded against all that follow.
HEAD = 100
#: A fraction this near to a whole number of copies is none.
TINY = 1e-12


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_key, source_size, target) of ``sizes(source_key, size)``, one row per source."""
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(0))
    placed = positions(per, "one", [F.col("source_key")], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1).cast("double")
    s = written(placed.select("source_key", "source_size", (most * F.col("source_size")).cast("double").alias("cap"),
                              weight.alias("weight")), "sources")
    total = float(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # a share by weight: raised while sources are cut to their caps; the set of these only grows
    share, held = 0.0, -1
    while True:
        cut = F.col("weight") * F.lit(share) > F.col("cap") if held >= 0 else F.lit(False)
        caps, free, now = s.agg(F.coalesce(F.sum(F.when(cut, F.col("cap"))), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0.0)), F.count(F.when(cut, 1))).first()
        if now == held or free == 0:
            break
        share, held = (total - caps) / free, now
    return s.select("source_key", "source_size", F.least(F.col("weight") * F.lit(share), F.col("cap")).alias("target"))


def pivoted(size: np.ndarray, mass: np.ndarray, draw: np.random.Generator) -> int:
    """Round ``mass`` (words of the fractional copy, between 0 and ``size``) in place, but for one entry: its index is returned."""
    w, m, last = size.tolist(), mass.tolist(), 0
    luck = draw.random(len(m)).tolist()
    for i in range(1, len(m)):
        a, b = m[last], m[i]
        up, down = min(w[last] - a, b), min(a, w[i] - b)  # words that can move to the earlier one, and from it
        if up + down <= 0:  # both are whole
            last = i
            continue
        if luck[i] * (up + down) < down:
            full, empty = (up == w[last] - a), (up == b)
            m[last], m[i] = (float(w[last]) if full else a + up), (0.0 if empty else b - up)
            whole = i if empty else last
        else:
            empty, full = (down == a), (down == w[i] - b)
            m[last], m[i] = (0.0 if empty else a - down), (float(w[i]) if full else b + down)
            whole = last if empty else i
        last = i if whole == last else last
    mass[:] = m
    return last


def against_rest(size: np.ndarray, part: float, rest: int, draw: np.random.Generator) -> tuple[np.ndarray, float]:
    """Round documents of one common fraction ``part``, one after the other, each against all that follow, of which ``rest`` words come
    after the last: (1 or 0 each, the fraction of the rest)."""
    out = np.zeros(len(size), bool)
    after = np.cumsum(size[::-1])[::-1] - size + rest
    luck = draw.random((len(size), 2))
    for i, (w, others) in enumerate(zip(size.tolist(), after.tolist(), strict=True)):
        give, take = w * (1 - part), w * part  # words that the others lose if it is taken, and get if it is not
        fill, empty = give <= part * others, take <= (1 - part) * others
        if fill and empty:
            out[i] = luck[i, 0] * (give + take) < take
        elif others == 0:
            out[i] = luck[i, 0] < part
        elif fill or empty:
            out[i] = fill
        else:
            out[i] = abs(w - take - part * others) < abs(others - take - part * others)
        if others:
            part = min(1.0, max(0.0, part + (-give if out[i] else take) / others))
            part = 0.0 if part < TINY else 1.0 if part > 1 - TINY else part
    return out, part


def _heads(head: int):
    """Round a source's longest documents; the last row has the fraction of the rest."""
    def run(key, rows):
        rows = rows.sort_by("pos")
        source, size = key[0].as_py(), rows.column("size").to_numpy()
        draw = np.random.default_rng([head, *source.encode()])
        took, part = against_rest(size, rows.column("part")[0].as_py(), rows.column("words")[0].as_py() - int(size.sum()), draw)
        ids = rows.column("doc_id").to_pylist()
        return pa.table({"source_key": pa.array([source] * (len(size) + 1)), "doc_id": pa.array([*ids, None], pa.int64()),
                         "size": pa.array([*size.tolist(), None], pa.int64()), "mass": pa.array([*(took * size).tolist(), part], pa.float64())})
    return run


def _node(level: int, fan: int):
    """Round one node's rows; the one left over has ``done`` false, unless its source has no other node."""
    def run(key, rows):
        rows = rows.sort_by("pos").drop_columns("node")
        source, node = key[0].as_py(), key[1].as_py()
        draw = np.random.default_rng([level, node, *source.encode()])
        size, mass = rows.column("size").to_numpy(), rows.column("mass").to_numpy().copy()
        left = pivoted(size, mass, draw)
        done = np.ones(len(size), bool)
        if rows.column("n")[0].as_py() <= fan ** (level + 1):
            mass[left] = size[left] if draw.random() * size[left] < mass[left] else 0
        else:
            done[left] = False
        # the next level's position: the node's number
        rows = rows.set_column(rows.column_names.index("pos"), "pos", pa.array(np.where(done, rows.column("pos").to_numpy(), node)))
        rows = rows.set_column(rows.column_names.index("mass"), "mass", pa.array(mass))
        return rows.append_column("done", pa.array(done))
    return run


def rounded(rows: DataFrame, fan: int = FAN, head: int = HEAD) -> DataFrame:
    """``rows(source_key, doc_id, size, part)`` (``part``: the fraction, one a source) with ``extra``: 1 if the fractional copy became a
    whole one, else 0."""
    fractional = (F.col("part") > 0) & (F.col("size") > 0)
    order = [F.col("size").desc(), F.xxhash64("doc_id"), F.col("doc_id"), F.col("_row")]
    numbered = written(rows.filter(fractional).withColumn("_row", F.monotonically_increasing_id()), "fractional")
    words_of = numbered.groupBy("source_key").agg(F.sum("size").alias("words"))
    placed = written(positions(numbered, "source_key", order, "pos", total="n").drop("_row"), "placed")
    long = placed.filter(F.col("pos") < head).join(words_of, "source_key")
    firsts = written(long.groupBy("source_key").applyInArrow(_heads(head), "source_key string, doc_id long, size long, mass double"), "heads")
    rest = firsts.filter("size IS NULL").select("source_key", F.col("mass").alias("now"))
    level = placed.filter(F.col("pos") >= head).join(rest, "source_key").select(
        "source_key", "doc_id", "size", (F.col("size") * F.col("now")).alias("mass"), (F.col("pos") - head).alias("pos"),
        (F.col("n") - head).alias("n"))
    most = (placed.agg(F.max("n")).first()[0] or 0) - head
    schema = "source_key string, doc_id long, size long, mass double, pos long, n long, done boolean"
    whole = ["source_key", "doc_id", "size", (F.col("mass") > 0).cast("int").alias("extra")]
    every = rows.filter(~fractional).select("source_key", "doc_id", "size", F.lit(0).alias("extra")).unionByName(
        firsts.filter("size IS NOT NULL").select(*whole))
    k = 0
    while most > 0:
        nodes = level.withColumn("node", F.floor(F.col("pos") / fan)).groupBy("source_key", "node")
        out = written(nodes.applyInArrow(_node(k, fan), schema), "level")
        every = every.unionByName(out.filter("done").select(*whole))
        if most <= fan ** (k + 1):
            break
        level, k = out.filter("not done").drop("done"), k + 1
    return every


def mixed(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, fan: int = FAN, head: int = HEAD) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): how often each document is taken, one row per document."""
    # a source's key that is never null and sorts null last
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    sizes = written(docs.select(key.alias("source_key"), F.col("doc_id").cast("long").alias("doc_id"),
                                F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    t = written(targets(sizes, most, weights), "targets")
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(r + TINY)
    t = t.withColumn("whole", whole).withColumn("part", F.greatest(r - whole, F.lit(0.0))).withColumn(
        "part", F.when(F.col("part") < TINY, 0.0).otherwise(F.col("part")))
    rows = sizes.join(t, "source_key").select("source_key", "doc_id", "size", "part")
    copies = F.col("whole") + F.col("extra")
    return rounded(rows, fan, head).join(t, "source_key").select(
        "doc_id", F.when(F.col("source_key") != "1", F.substring("source_key", 2, 1 << 30)).alias("source"), "size", "source_size",
        "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def copied(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each document as often as its copies say (ids must be unique and not null)."""
    ident, many = fresh(docs, "_mixed"), fresh(docs, "_copies")
    m = mix.select(F.col("doc_id").alias(ident), F.col("copies").cast("int").alias(many))
    joined = docs.join(m, docs["doc_id"] == m[ident])
    return joined.withColumn(many, F.explode(F.array_repeat(F.lit(1), F.col(many)))).drop(ident, many)
