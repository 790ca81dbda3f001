"""Queries over the standard tables, each with the SQL that gives the same rows."""

from pagewright.registry import corpus, feedback, retrieval, scoring, sessions, texts  # noqa: F401
from pagewright.registry.common import QUERIES, SQL  # noqa: F401
