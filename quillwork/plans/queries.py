"""All queries of the library's own operators."""

from quillwork.plans import corpus, evidence, outcomes, records  # noqa: F401  (they register)
from quillwork.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
