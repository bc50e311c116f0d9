"""Feed state folded batch by batch equals the state over all checks (F-2, J-2)."""

import datetime as dt
import random

from litfeed.operators import feedstate as FS

SCHEMA = "feed_id string, seq long, status string, error string, etag string, last_modified string, checked_at timestamp"


def test_fold_equals_whole(spark):
    rng = random.Random(5)
    rows = []
    for s in range(400):
        st = rng.choice(["ok", "ok", "not_modified", "partial", "error"])
        rows.append((f"f{rng.randrange(7)}", s, st, None if st in ("ok", "not_modified") else "E",
                     rng.choice([None, f"e{s}"]), rng.choice([None, f"m{s}"]),
                     dt.datetime(2024, 1, 1) + dt.timedelta(minutes=s)))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = FS.fold_state(None, df)
    step = None
    for lo in range(0, 400, 90):
        part = df.where(f"seq >= {lo} AND seq < {lo + 90}")
        step = FS.fold_state(step, part).cache()
    key = lambda d: sorted(tuple(r) for r in d.select(*whole.columns).collect())
    assert key(step) == key(whole) == key(FS.final_state(df).select(*whole.columns))
