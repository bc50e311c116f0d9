"""litfeed: a Spark-native engine for scientific literature feeds.

Every public function takes and returns DataFrames; the heavy work runs as
Spark jobs (scans, joins, aggregates, windows) so the same code serves one
landed batch, an incremental micro-batch, or a corpus far larger than a host.
"""

from litfeed.session import get_spark, checkpoint_dir, ensure_utc

__all__ = ["get_spark", "checkpoint_dir", "ensure_utc"]
