"""Registered queries, their SQL counterparts and the shared label fixture."""

from checks.registry import QUERIES, SQL  # noqa: F401
from checks import batch_queries, label_queries, text_queries  # noqa: F401
