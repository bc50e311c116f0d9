"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension broadcast to every task must stay far below executor memory.
MAX_BROADCAST_ROWS = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a checked row bound; beyond it let the planner shuffle.

    The check reads at most ``max_rows + 1`` rows of a dimension (cheap), never
    the fact side.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def single_row(*aggs: DataFrame) -> DataFrame:
    """Side-by-side columns of several one-row aggregates, without a join.

    Each aggregate is unioned as a sparse row, then one global aggregate
    folds them together.
    """
    names = [c for a in aggs for c in a.columns]
    types = {f.name: f.dataType for a in aggs for f in a.schema.fields}
    parts = [a.select(*[(F.col(n) if n in a.columns else F.lit(None).cast(types[n])).alias(n) for n in names])
             for a in aggs]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(n).alias(n) for n in names])


def ensure_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a CPU-heavy input that comes from fewer files than the cluster has
    cores (e.g. one file with a single large row group) by hashing on ``keys``.

    Decided from the plan's input file list (no job is run); a dataset of many
    files at scale is left as it is, so no shuffle is added there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    try:
        files = len(df.inputFiles())
    except Exception:  # non-file sources: leave the plan alone
        return df
    if files == 0 or files >= want:
        return df
    return df.repartition(want, *keys)
