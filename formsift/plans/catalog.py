"""All registered queries."""

from formsift.plans import (  # noqa: F401
    activity_queries, dictionary_queries, field_queries, quality_queries, reading_queries,
    record_queries, record_quality_queries, stream_queries,
)
from formsift.plans.registry import CHECKS, QUERIES  # noqa: F401
