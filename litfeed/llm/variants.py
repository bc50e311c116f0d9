"""Spelling variant grouping: words that differ by one edit, found by dense comparison of tiles of words.

Words come from the maximal runs of letters of all whole texts, A-Z in lower case; one of 199 runs by CRC loses a letter (typos that
the query plants). Words of at least ``LEAST_LENGTH`` letters that occur at least ``LEAST_COUNT`` times are compared.

Dense prefix-suffix tiling. Two words are one insertion, deletion or replacement apart if and only if their lengths differ by at most
one and common prefix plus common suffix reach the longer length M minus one. So one of the two parts has at least M // 2 letters: each
word is listed under its first and its last M // 2 letters, for M its own length and one more (four keys). The keyed words are
sorted by (key, word) over the whole cluster and cut into tiles of ``TILE`` letters. A tile is compared with itself and with the tiles
that its last key goes on in: both become padded matrices of code points, common prefixes and suffixes of all their pairs are
counted column by column, and pairs of one key that reach M - 1 are near. A pair counts under its prefix key, and under its
suffix key only if the prefix alone does not list it, so once. A block pair gives one row a word: how many near words, and the best.

Scale: a tile has a bounded number of letters (a longer word is a tile of its own) and a task holds two tiles at a time; a key of many
words is many tiles, whose block pairs are dealt over all tasks, so no group meets in one task. Nothing is dropped. Tiles that
share no key are never compared.

Forms. A word's form is its near word of largest count n (ties: smallest) if that is at least ``RATIO`` times its own. Counts grow along
forms by that ratio, so chains are short; roots come by pointer doubling over the words that have a form.

Edge cases: null texts have no words; a null id is empty in the CRC's text; repeated rows count as often as they occur; texts without
letters, or no word often enough, give an empty result; very long words are compared like others; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litfeed.llm.common import ascii_lower, positions, written

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many runs loses a letter.
TYPO = 199
#: Letters of a tile, about.
TILE = 4096


def runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters that have at least ``least`` of them."""
    return F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def counted(docs: DataFrame, least: int = LEAST_LENGTH, often: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n): the words to compare. A run of more letters than the least may lose one and still be a word."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col("text"), least)).alias("run"))
    # ``lower`` is the fast way, right for A-Z where all is ASCII
    d = d.withColumn("run", F.when(F.length("run") == F.octet_length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run"))))
    d = d.withColumn("h", F.crc32(F.concat("id", F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run"))
    return d.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(
        F.col("n") >= often)


def keyed(words: DataFrame) -> DataFrame:
    """(key, word, n): each word under its first and last ``M // 2`` letters, for M its length and one more."""
    size = F.length("word")
    keys = []
    for longer in (size, size + 1):
        half = F.floor(longer / 2).cast("int")
        for side, part in (("p", F.substring(F.col("word"), F.lit(1), half)), ("s", F.substring(F.col("word"), size - half + 1, half))):
            keys.append(F.concat(longer.cast("string"), F.lit(side), part))
    return words.select(F.explode(F.array(*keys)).alias("key"), "word", "n")


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(tile, rows, last): the keyed words in order of (key, word), cut into tiles; ``last``: the tile that its last key ends in."""
    k = keyed(words).withColumns({"one": F.lit(0), "letters": F.length("word").cast("long")})
    placed = positions(k, "one", [F.col("key"), F.col("word")], "at", weight="letters")
    placed = written(placed.select("key", "word", "n", F.floor(F.col("at") / tile).alias("tile")), "keyed")
    cut = placed.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("key", "word", "n"))).alias("rows"))
    ends = placed.groupBy("key").agg(F.max("tile").alias("last"))
    last_key = F.element_at("rows", -1)["key"]
    return written(cut.withColumn("key", last_key).join(ends, "key").select("tile", "rows", "last"), "tiles")


class Tile:
    """A tile's words as matrices of code points (all below 256), padded with 0 at the right and at the left."""

    def __init__(self, rows: pa.Array):
        self.key = rows.field("key").to_pylist()
        self.word = rows.field("word").to_pylist()
        self.n = rows.field("n").to_numpy(zero_copy_only=False)
        coded = [w.encode("latin-1") for w in self.word]
        self.size = np.fromiter(map(len, coded), np.int64, len(coded))
        # the longer length that a key stands for, and its side
        self.longer = np.fromiter((int(k[:_digits(k)]) for k in self.key), np.int64, len(coded))
        self.prefix = np.fromiter((k[_digits(k)] == "p" for k in self.key), bool, len(coded))
        wide = int(self.size.max())
        self.left = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in coded), np.uint8).reshape(-1, wide)
        self.right = np.frombuffer(b"".join(c.rjust(wide, b"\0") for c in coded), np.uint8).reshape(-1, wide)[:, ::-1]


def _digits(key: str) -> int:
    return next(i for i, c in enumerate(key) if not c.isdigit())


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of all pairs of rows of two padded matrices."""
    out = np.zeros((len(a), len(b)), np.int32)
    alive = np.ones((len(a), len(b)), bool)
    for j in range(min(a.shape[1], b.shape[1])):
        alive &= a[:, j, None] == b[None, :, j]
        if not alive.any():
            break
        out += alive
    return out


def compared(a: Tile, b: Tile, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): near pairs of a block pair, each only under one of its keys (``same``: both tiles are one)."""
    names = {k: i for i, k in enumerate(dict.fromkeys([*a.key, *b.key]))}
    ka, kb = (np.fromiter((names[k] for k in t.key), np.int64, len(t.key)) for t in (a, b))
    longer = np.maximum(a.size[:, None], b.size[None, :])
    meet = (ka[:, None] == kb[None, :]) & (longer == a.longer[:, None])
    if same:
        meet &= ~np.eye(len(a.size), dtype=bool)
    if not meet.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    front, back = common(a.left, b.left), common(a.right, b.right)
    # padding is equal beyond the end of both words
    short = np.minimum(a.size[:, None], b.size[None, :])
    front, back = np.minimum(front, short), np.minimum(back, short)
    near = meet & (longer - short < 2) & (front + back >= longer - 1) & (a.prefix[:, None] | (front < longer // 2))
    return np.nonzero(near)


def _best(t: Tile, other: Tile, i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """(word, near words, the best one's count, the best one) for each word of ``t`` with near words ``other[j]``."""
    order = sorted(range(len(other.word)), key=lambda x: (-other.n[x], other.word[x]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    count, best = np.bincount(i, minlength=len(t.word)), np.full(len(t.word), len(order))
    np.minimum.at(best, i, rank[j])
    return [(t.word[x], int(count[x]), int(other.n[order[best[x]]]), other.word[order[best[x]]]) for x in np.flatnonzero(count)]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best): the words with near ones, how many, and the most frequent of these (ties: the smallest)."""
    t = tiles(words, tile)
    pairs = t.select(F.col("tile").alias("a"), F.explode(F.sequence("tile", "last")).alias("b"))
    left, right = t.select(F.col("tile").alias("a"), F.col("rows").alias("left")), t.select(F.col("tile").alias("b"), F.col("rows").alias("right"))

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for k in range(block.num_rows):
                at = [block.column(c).slice(k, 1) for c in range(4)]
                same = at[0][0].as_py() == at[1][0].as_py()
                a = Tile(at[2].flatten())
                b = a if same else Tile(at[3].flatten())
                i, j = compared(a, b, same)
                found = _best(a, b, i, j) + ([] if same else _best(b, a, j, i))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _NEAR, strict=True)],
                                                     schema=_NEAR)

    blocks = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    found = blocks.mapInArrow(run, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select(
        "word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms followed to the last, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                             F.col("next").isNotNull().alias("moved")), "roots")
        if not ahead.filter("moved").head(1):
            return ahead.drop("moved")
        at = ahead.drop("moved")


def grouped(words: DataFrame, ratio: int = RATIO, tile: int = TILE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words(word, n)``."""
    words = written(words, "words")
    best = words.join(near_words(words, tile), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    out = written(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"),
                              F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    return out.join(roots(out.filter("form IS NOT NULL").select("word", "form")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))
