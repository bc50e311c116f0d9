"""Case folding against the standard library."""

import random
from unicodedata import category

from pyspark.sql import functions as F

from litfeed.functions.text import casefold


def folded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    return [r[0] for r in df.orderBy("i").select(casefold(F.col("t"))).collect()]


def test_every_code_point(spark):
    """All but those that the standard library's Unicode version does not assign: Spark's own may be newer and lower-cases them."""
    points = [c for c in map(chr, range(0x110000)) if category(c) not in ("Cn", "Cs")]
    blocks = ["\n".join(points[i:i + 512]) for i in range(0, len(points), 512)]
    for given, got in zip(blocks, folded(spark, blocks)):
        assert got == given.casefold()


def test_texts(spark):
    rnd = random.Random(2)
    some = ["Σ", "ς", "ß", "ẞ", "ﬃ", "İ", "ŉ", "Ꭰ", "ꭰ", "µ", "A", "b", " ", "ΐ", "ᾳ", "\U00010400", "é", "\0"]
    texts = ["".join(rnd.choices(some, k=rnd.randint(0, 9))) for _ in range(400)] + ["ΟΔΥΣΣΕΥΣ ΟΔΟΣ", "Straße", "", "ASCII only"]
    assert folded(spark, texts + [None]) == [t.casefold() for t in texts] + [None]
