"""Queries of this subpackage and their DuckDB checks."""

from formsift.llm import text_queries  # noqa: F401
from formsift.llm.registry import CHECKS, QUERIES  # noqa: F401
