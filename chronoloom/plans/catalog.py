"""All queries of the timeline engine by name, and their SQL."""

from chronoloom.plans import ports, screens  # noqa: F401  they add their queries
from chronoloom.plans.queries import QUERIES, SQL, dwell_by_app

__all__ = ["QUERIES", "SQL", "dwell_by_app"]
