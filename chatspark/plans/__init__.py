"""The library's queries over the driver tables."""

from chatspark.plans import corpus, features, history, jobs, knowledge, ranking, retrieval, verdicts  # noqa: F401
from chatspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
