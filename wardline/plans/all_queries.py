"""All registered queries."""

from wardline.plans import audit_queries, corpus_queries, inspect_queries, outcome_queries, stream_queries, text_queries  # noqa: F401
from wardline.plans.registry import ORACLES, QUERIES  # noqa: F401
