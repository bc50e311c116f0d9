"""Import every query module so the registry is complete."""

from litfeed.plans import q_enrich, q_feeds, q_identity, q_misc, q_runs, q_search, q_stream, q_transforms  # noqa: F401
from litfeed.plans.registry import REGISTRY  # noqa: F401
