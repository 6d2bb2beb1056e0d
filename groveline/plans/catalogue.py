"""Imports every module that registers queries."""

from groveline.plans import evidence_queries, text_queries, tree_queries, vector_queries  # noqa: F401
