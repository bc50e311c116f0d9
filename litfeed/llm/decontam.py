"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment
(native: DataFrame functions only).

Find short test items inside long documents. A text is its set of distinct five-word shingles. An item of one to four words is
its whole word sequence, looked for among the documents' shingles of the item's own length (an item without words is never
found). Item Q is contained in document D if ``|S(Q) & S(D)| >= 0.8 * |S(Q)|``.

Search. Items are partitioned by size (powers of two of their shingle count). Every partition has its sketch
length, ``k = floor((1 - t) * largest size) + 1``, and an item's sketch is its k smallest shingle hashes (bottom-k
MinHash). At a containment of t at most ``floor((1 - t) * n)`` of an item's shingles are missing, so at least one of
its k sketch hashes is in the document: the search loses nothing, at any document length, and needs no bands to be
tuned. A document's hashes above the largest sketch hash are dropped before the shuffle. An item's sketch hash that
is also in many documents costs rows as often as it occurs, never pairs of documents.

Both passes are scans: the candidates' ids are written, and their documents are found by a broadcast of the ids up to ``FEW`` of them,
which the written table proves; only beyond that do texts travel by id.

Verification. Shingle texts (not hashes) of the candidate documents are joined with those of the items, counted per
(document, item), map-side first. Documents are only grouped by themselves, so copies or a hot source do not
meet in one task.

Edge cases: null texts have no words; rows of documents with equal ids are told apart; null ids are kept as null;
repeated items give repeated pairs (one per item row); empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import ascii_lower, fresh, let, written
from litfeed.operators.util import bounded_broadcast

SHINGLE = 5
THRESHOLD = 0.8
#: Candidate ids (numbers of 64 bits) that are broadcast at most.
FEW = 1_000_000
#: Words here: runs of ASCII letters, digits and anything beyond ASCII, so punctuation and case do not hide a leak.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _starts(w, size: int):
    """Start positions (from 0) of the shingles of a word array."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, size: int) -> DataFrame:
    """``_w``: words; ``_h``: distinct shingle hashes (64 bit, so 2^63 in signed order is as good as random)."""
    return df.withColumn("_h", let(F.transform("_w", lambda x: F.xxhash64(x)), lambda wh: F.array_distinct(
        F.transform(_starts(wh, size), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(size)])))))


def _shingles(w, size: int):
    return let(w, lambda ws: F.array_distinct(F.transform(
        _starts(ws, size), lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(size)]))))


def sketches(items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(item_row, part, hash): the bottom-k sketch of each item, k set by its size partition."""
    h = _hashed(items.select("item_row", _words(F.col("text")).alias("_w")), size).filter(F.size("_h") > 0)
    # partition p holds sizes 2^p to 2^(p+1) - 1; one k for the whole partition
    h = h.withColumn("part", F.floor(F.log2(F.size("_h"))).cast("int"))
    per = h.groupBy("part").agg(F.max(F.size("_h")).alias("largest"))
    k = F.floor(F.lit(round(1 - threshold, 9)) * F.col("largest") + 1e-9).cast("int") + 1
    return h.join(per.withColumn("k", k), "part").select(
        "item_row", "part", F.explode(F.slice(F.sort_array("_h"), F.lit(1), F.col("k"))).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD,
              row: str | None = None) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every pair at or above the threshold.

    ``row``: a column of ``docs`` that tells its rows apart; then it takes the place of ``doc_id``.
    """
    ident = row or "doc_id"
    # items: small against the documents, but of no fixed size; all that follows uses plain joins
    items = written(items.select("item_id", "text", F.least(F.size(_words(F.col("text"))), F.lit(size)).alias("_n")).withColumn(
        "item_row", F.monotonically_increasing_id()), "items")
    out = None
    # five words, and each shorter length that an item has
    for n in sorted(r["_n"] for r in items.select("_n").distinct().collect() if r["_n"]):
        found = _contained(docs, items.filter(F.col("_n") == n), n, threshold, ident, row is None)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    empty = docs.sparkSession.createDataFrame([], "n_shared long, n_item long, containment double")
    ids = docs.select(F.col(ident)).limit(0).crossJoin(items.select("item_id").limit(0))
    return ids.crossJoin(empty)


def _contained(docs: DataFrame, items: DataFrame, size: int, threshold: float, ident: str, nulls: bool) -> DataFrame:
    """The pairs with items of one shingle length."""
    sketch = written(sketches(items, size, threshold), "sketches")
    top = sketch.agg(F.max("hash")).first()[0]
    d = docs.select(F.col(ident).alias("_id"), "text").filter(F.col("_id").isNotNull() | F.lit(nulls))
    hashed = _hashed(d.select("_id", _words(F.col("text")).alias("_w")), size)
    low = hashed.select("_id", F.filter("_h", lambda x: x <= top).alias("_h")).select(
        "_id", F.explode("_h").alias("hash"))
    hit = written(low.join(sketch.select("hash").distinct(), "hash", "left_semi").select(F.col("_id").alias("_c")).distinct(), "hits")
    # candidate documents only: exact shingles
    cand = d.join(bounded_broadcast(hit, FEW), F.col("_id").eqNullSafe(F.col("_c")), "left_semi")
    ds = cand.withColumn("_r", F.monotonically_increasing_id()).select("_r", "_id", _words(F.col("text")).alias("_w"))
    ds = ds.select("_r", "_id", F.explode(_shingles(F.col("_w"), size)).alias("shingle"))
    qs = items.select("item_row", "item_id", _words(F.col("text")).alias("_w"))
    qs = qs.select("item_row", "item_id", _shingles(F.col("_w"), size).alias("_s"))
    qs = qs.select("item_row", "item_id", F.size("_s").cast("long").alias("n_item"), F.explode("_s").alias("shingle"))
    both = ds.join(qs, "shingle").groupBy("_r", "_id", "item_row", "item_id", "n_item").agg(
        F.count("*").alias("n_shared"))
    good = both.filter(F.col("n_shared") >= F.col("n_item") * threshold - 1e-9)
    return good.select(F.col("_id").alias(ident), "item_id", "n_shared", "n_item",
                       (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with their columns."""
    row = fresh(docs, "_row")
    d = written(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    hit = contained(d.select(row, "text"), items, row=row).select(row).distinct()
    return d.join(hit, row, "left_anti").drop(row)
